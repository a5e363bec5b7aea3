"""Token counts of documents in flat token files, by scanning for end-of-document identifiers.

A flat file is little-endian 16- or 32-bit ids on end, without an index.  Files
are cut into blocks of fixed size; a task finds the separators of a block with
one vectorised comparison, and a prefix scan over block summaries (separators so
far, place of the last one), a row a block, stitches documents that span blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .token_ids import default_path, encoder

BLOCK_BYTES, END_ID, DTYPE = 4 << 20, 50256, "<u2"

_WRITTEN = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.int64())])
_SCANNED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()), ("n_ends", pa.int64()), ("last_end", pa.int64()), ("ends", pa.list_(pa.int64()))])
_SCANNED_DDL = "file string, block long, tokens long, n_ends long, last_end long, ends array<long>"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, dtype: str = DTYPE) -> DataFrame:
    """Write the ids of every text, each followed by end_id, to one flat file per task below folder (a URI all executors reach).

    Runs now.  Gives (file, ordinal, doc_id, bytes): a row per document in file
    order, and one per file whose ordinal is null and which says its length.
    File names hold the attempt, so what a lost task left is never read.  Text
    that spells a special token is ordinary text, so end_id stands at ends only
    where the vocabulary has no other use for it.  Identifiers that dtype can't
    hold are an error.
    """
    path = tokenizer or default_path()
    if max(encoder(path).vocabulary_size - 1, end_id) > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} is too narrow for the identifiers of {path}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        system, where = fs.FileSystem.from_uri(name)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        ordinal = size = 0
        end = np.array([end_id], dtype).tobytes()
        with system.open_output_stream(where) as out:
            for batch in batches:
                for text in batch.column("text"):
                    b = encode(text.as_py(), special=False).astype(dtype).tobytes() + end
                    out.write(b)
                    size += len(b)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id"), pa.nulls(n, pa.int64())], schema=_WRITTEN)
                ordinal += n
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([size], pa.int64())], schema=_WRITTEN)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty())
    return C.materialize(base.mapInArrow(run, "file string, ordinal long, doc_id long, bytes long"), "token-files")


def _scan(end_id: int, dtype: str, block_bytes: int):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "bytes"))):
                system, where = fs.FileSystem.from_uri(name)
                begin = block * block_bytes
                with system.open_input_file(where) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - begin), begin), dtype)
                ends = np.flatnonzero(ids == end_id) + begin // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], schema=_SCANNED
                )

    return run


def count_tokens(files: DataFrame, end_id: int = END_ID, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in flat token files.

    files: (file, bytes), a URI and its length.  n_tokens leaves the end
    identifier out; what follows the last one of a file is a document of its own
    if it is not empty, with ended = false.  Two identifiers in a row hold a
    document of 0 tokens.  An empty file gives no rows.
    """
    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("blocks must hold whole identifiers")
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes).cast("long"))).alias("block"))
    scanned = C.materialize(blocks.repartition("file", "block").mapInArrow(_scan(end_id, dtype, block_bytes), _SCANNED_DDL), "separators")  # each file is read once
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summaries = scanned.select("file", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("prev"))
    stitched = scanned.select("file", "block", "ends").where("size(ends) > 0").join(summaries, ["file", "block"])
    at = stitched.select("file", "base", "prev", "ends", F.posexplode("ends").alias("k", "end"))
    n = F.col("end") - F.when(F.col("k") == 0, F.col("prev")).otherwise(F.get("ends", F.col("k") - 1)) - 1
    whole = at.select("file", (F.col("base") + F.col("k")).alias("ordinal"), n.alias("n_tokens"), F.lit(True).alias("ended"))
    totals = scanned.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("last"))
    rest = totals.where("tokens - last > 1").select("file", "ordinal", (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def document_token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row of docs, by way of flat token files in the shared folder.

    A null or empty text has 0 tokens; null doc_ids and repeated rows give a row
    each; an empty table gives none; other columns of docs are ignored.
    """
    spark: SparkSession = docs.sparkSession
    written = write_token_files(docs, C.new_path(spark, "tokens") + "-flat", tokenizer)
    counts = count_tokens(written.where("ordinal is null").select("file", "bytes"))
    # as Parquet these rows are a few bits each: without the hint the size of the file would pass for a small table
    return written.where("ordinal is not null").hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
