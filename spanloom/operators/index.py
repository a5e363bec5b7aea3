"""Stored postings, term statistics and lengths of a collection.

postings: a row per feature and document (positions, the document's length, and
tf, the occurrences as a split word), in directories by a hash of the feature and
sorted by feature and document, so that a query reads the directories and row
groups of its terms only.  terms: a row per feature.  A feature of many documents
is spread over several files of its directory.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from . import stats as S

#: At most as many directories as Spark lists without a job of its own.
BUCKETS = 32
#: Words of the documents whose postings one task sorts and writes for all directories, about: a file has its share of them.
WORDS_A_PART = 1 << 26
#: Postings that Python hands to Spark at once, about.
ROWS_A_BATCH = 50_000
#: Terms of a query that become a filter; more of them are joined.
FILTER_TERMS = 1000
_POSTINGS = "feature string, doc long, len long, tf long, positions array<int>, bucket int"
_TERMS = "feature string, df long, ctf long, count long, bucket int"


def bucket_of(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(buckets)).cast("int")


@contextmanager
def _unsorted(spark: SparkSession):
    """Writes below it don't sort by directory: a task here writes one only, and a sort by that first compares rows in full."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of texts, each document's gathered by itself: a dictionary of its words takes a tenth of what lambda functions over arrays do."""
    find, columns, positions, ends = re.compile(T.ASCII).findall, ([], [], [], []), array("i"), array("i", [0])

    def batch() -> pa.RecordBatch:
        doc, size, feature, tf = columns
        own = pa.ListArray.from_arrays(pa.array(np.array(ends)), pa.array(np.array(positions)))
        made = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(feature, pa.string()), pa.array(tf, pa.int64()), own], names=["doc", "len", "feature", "tf", "positions"])
        for c in columns:
            c.clear()
        del positions[:], ends[1:]
        return made

    for b in batches:
        for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
            spelled: dict[str, list[int]] = defaultdict(list)
            words = find(text or "")
            for i, w in enumerate(words):
                spelled[w].append(i)
            found: dict[str, list] = {}  # tf and positions of a feature
            for w, at in spelled.items():
                low = w.lower()
                inner = w[1:] != low[1:]
                if inner:
                    found[w] = [len(at), at]
                if (x := found.get(low)) is None:
                    found[low] = [0 if inner else len(at), at]
                else:
                    found[low] = [x[0] + (0 if inner else len(at)), sorted(x[1] + at)]
            columns[0].extend([doc] * len(found))
            columns[1].extend([len(words)] * len(found))
            columns[2].extend(found)
            for tf, at in found.values():
                columns[3].append(tf)
                positions.extend(at)
                ends.append(len(positions))
            if len(columns[0]) >= ROWS_A_BATCH:
                yield batch()
    if columns[0]:
        yield batch()


class Index(S.Stats):
    """An index below a path; docs: the (doc, text) it was built of, for the texts of chosen documents."""

    def __init__(self, spark: SparkSession, path: str, docs: DataFrame, buckets: int = BUCKETS):
        super().__init__(docs)
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, docs: DataFrame, path: str, buckets: int = BUCKETS) -> Index:
        """Write the tables, totals last; what an interrupted build left is overwritten."""
        spark = docs.sparkSession
        docs.select("doc", F.size(T.ascii_words(F.col("text"))).cast("long").alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")
        parts = 1 + (spark.read.parquet(f"{path}/lengths").agg(F.sum("len")).first()[0] or 0) // WORDS_A_PART
        rows = docs.select("doc", "text").mapInArrow(_gathered, "doc long, len long, feature string, tf long, positions array<int>")
        rows = rows.repartitionById(buckets * parts, bucket_of(F.col("feature"), buckets) + buckets * bucket_of(F.col("doc"), parts))
        rows = rows.sortWithinPartitions("feature", "doc").withColumn("bucket", bucket_of(F.col("feature"), buckets))
        with _unsorted(spark):
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        index = cls(spark, path, docs, buckets)
        terms = index.rows().groupBy("bucket", "feature").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"), F.sum("tf").alias("ctf"), F.sum(F.size("positions").cast("long")).alias("count"))
        terms = terms.repartitionById(buckets * parts, bucket_of(F.col("feature"), buckets * parts))  # of one bucket each, for their number is a multiple
        with _unsorted(spark):
            terms.sortWithinPartitions("feature").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        lengths = index.lengths().where("length > 0").agg(F.count("*").alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        lengths.crossJoin(index.terms().agg(F.count("*").alias("vocab"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")  # one row with one row
        return index

    def whole(self) -> bool:
        """Whether the index is there: its last table is written."""
        return shared.exists(self.spark, f"{self.path}/totals/_SUCCESS")

    def _filtered(self, table: str, ddl: str, features: list[str] | None) -> DataFrame:
        rows = self.spark.read.schema(ddl).parquet(f"{self.path}/{table}")
        if features is None:
            return rows
        if not features:
            return rows.where("false")
        quoted = ["'" + f.replace("\\", "\\\\").replace("'", "\\'") + "'" for f in features]
        # as text, for the parser takes a thousand of them in one go; hashes are folded before files are listed
        buckets = ", ".join(f"CAST(pmod(xxhash64({f}), {self.buckets}) AS INT)" for f in quoted)
        return rows.where(f"bucket IN ({buckets}) AND feature IN ({', '.join(quoted)})")

    def rows(self, features: list[str] | None = None) -> DataFrame:
        """(feature, doc, len, tf, positions, bucket)."""
        return self._filtered("postings", _POSTINGS, features)

    def terms(self, features: list[str] | None = None) -> DataFrame:
        """(feature, df, ctf, count, bucket)."""
        return self._filtered("terms", _TERMS, features)

    def lengths(self) -> DataFrame:
        return self.spark.read.schema("doc long, len long").parquet(f"{self.path}/lengths").select("doc", F.col("len").alias("length"))

    def _few(self, terms: DataFrame) -> list[str] | None:
        return S.few_of(terms, FILTER_TERMS)

    def _of(self, table: str, terms: DataFrame | None, broadcast: bool) -> DataFrame:
        """Rows of the terms: by a filter where they are few, else by a join on feature and bucket."""
        read = self.rows if table == "postings" else self.terms
        if terms is None or (few := self._few(terms)) is not None:
            return read(None if terms is None else few)
        keys = terms.select(F.col("term").alias("feature")).distinct().withColumn("bucket", bucket_of(F.col("feature"), self.buckets))
        return read().join(F.broadcast(keys) if broadcast else keys, ["bucket", "feature"], "left_semi")

    def tf(self, terms: DataFrame | None = None) -> DataFrame:
        return self._of("postings", terms, True).where("tf > 0").select("doc", "len", F.col("feature").alias("term"), "tf")

    def weights(self, own: DataFrame, terms: DataFrame | None = None) -> DataFrame:
        return self._of("terms", terms, True).where("df > 0").select(F.col("feature").alias("term"), "df", "ctf")

    def split_words(self) -> DataFrame:
        return self.terms().where("df > 0").select(F.col("feature").alias("word"))

    def df(self, terms: DataFrame, is_small: bool = False) -> DataFrame:
        return self._of("terms", terms, is_small).where("df > 0").select(F.col("feature").alias("term"), "df")

    def totals(self) -> DataFrame:
        t = self.spark.read.schema("items long, length long, vocab long").parquet(f"{self.path}/totals")
        return t.select("items", "length", (F.col("length") / F.greatest("items", F.lit(1))).alias("avgl"))

    def vocabulary(self) -> DataFrame:
        return self.spark.read.schema("items long, length long, vocab long").parquet(f"{self.path}/totals").select("vocab")

    def counts(self, features: list[str] | None = None) -> DataFrame:
        return self.terms(features).select("feature", "count")

    def postings(self, features: list[str]) -> DataFrame:
        """(feature, doc, p) of features."""
        return self.rows(features).select("feature", "doc", F.explode("positions").alias("p")).withColumn("p", F.col("p").cast("long"))
