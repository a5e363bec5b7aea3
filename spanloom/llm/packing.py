"""Harmonic packing of token sequences.

A length belongs to the class k of the reciprocal capacity: capacity / (k + 1) <
length <= capacity / k, and a bin of class k always takes k pieces.  Documents
may be cut, so a length is cut to floor(capacity / k) exactly and the rest goes
to its own class; below capacity / CUT_CLASSES a rest is left as it is, which
wastes less than a part in CUT_CLASSES of its bin.  Every task fills bins by
itself: nothing is shuffled.  The bins that are open when a task ends are cut
anew into whole sequences, so that a task pads one sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_ids import default_path, encoder

CAPACITY = 2048
END_ID = 1
#: Lengths up to CAPACITY / CUT_CLASSES aren't cut any further.
CUT_CLASSES = 32

_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class_k", pa.int32())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class_k int"


def harmonic_cuts(length: int, capacity: int = CAPACITY, cut_classes: int = CUT_CLASSES) -> list[tuple[int, int]]:
    """(piece length, class) of a document's tokens, in order."""
    out = []
    while length:
        if length >= capacity:
            k, size = 1, capacity
        else:
            k = capacity // length
            size = length
            if k < cut_classes and length < capacity // k:  # between two classes: cut to the next smaller one exactly
                k += 1
                size = capacity // k
        out.append((size, k))
        length -= size
    return out


class HarmonicBins:
    """Bins of one task: add() pieces, take finished rows from `rows`, then close()."""

    def __init__(self, first_sequence: int, capacity: int, with_ids: bool):
        self.capacity, self.next, self.with_ids = capacity, first_sequence, with_ids
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list, k: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, k)
            self.rows.append((*row, ids) if self.with_ids else row)
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        for size, k in harmonic_cuts(total, self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[start : start + size] if size == self.capacity else ids[start : start + size].copy(), total))  # a view would keep the whole text's ids alive
            start += size
            if len(bin_) == k:
                self._emit(self.open.pop(k), k)

    def close(self) -> None:
        """Cut what the open bins hold into full sequences; class 0 marks them."""
        left = [x for k in sorted(self.open) for x in self.open[k]]
        self.open, now, room = {}, [], self.capacity
        for doc, start, ids, total in left:
            while len(ids):
                now.append((doc, start, ids[:room], total))
                took = min(room, len(ids))
                ids, start, room = ids[took:], start + took, room - took
                if not room:
                    self._emit(now, 0)
                    now, room = [], self.capacity
        if now:
            self._emit(now, 0)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack the texts of docs into sequences of at most `capacity` tokens; one row per piece.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class_k
    and, with_ids, the ids of the piece.  Text that spells a special token of the
    vocabulary is that token.  A text that is null or empty is the single token
    end_id; a text of any length is cut.  Null doc_ids and repeated rows are packed like any
    other row.  sequence_id is the task's number times 2**33 plus its bins so
    far; sequences are shorter than capacity where a class leaves a rest and at
    the end of a task.  An empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or default_path()
    out = _OUT.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _OUT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        bins = HarmonicBins(TaskContext.get().partitionId() << 33, capacity, with_ids)

        def full():
            rows, bins.rows = bins.rows, []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                bins.add(doc, np.append(encode(text.as_py()), np.uint32(end_id)))
                if len(bins.rows) >= 10_000:
                    yield full()
        bins.close()
        if bins.rows:
            yield full()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty())
    return base.mapInArrow(run, _DDL + (", ids array<int>" if with_ids else ""))
