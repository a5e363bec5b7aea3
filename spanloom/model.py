"""Collections: documents, their tokens and the annotations over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import intervals as I
from .plans import expr as X
from .plans.lower import lower

ANNOTATION = "feature string, doc long, p long, q long, v double, n long"


class Collection:
    """Texts with a token address space per document.

    docs: (doc, text); annotations: (feature, doc, p, q, v, n) beside the tokens,
    which come from a stored index (operators/index.py) if there is one, else from
    the texts when a query asks for them.
    """

    def __init__(self, docs: DataFrame, annotations: DataFrame | None = None, params: dict | None = None, index=None):
        self.docs, self.annotations, self.params, self.index = docs, annotations, dict(params or {}), index

    @classmethod
    def of(cls, df: DataFrame, id_col: str, text_col: str, **more) -> Collection:
        return cls(df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), **more)

    def annotate(self, rows: DataFrame) -> Collection:
        """With more annotations; rows whose p > q, whose p is negative or whose feature is null or empty are dropped."""
        rows = rows.where("p <= q and p >= 0 and feature <> ''").select("feature", "doc", "p", "q", "v", "n")
        return Collection(self.docs, rows if self.annotations is None else self.annotations.unionByName(rows), self.params, self.index)

    def indexed(self, path: str) -> Collection:
        """With an index, which is built below path unless it is there."""
        from .operators.index import Index

        index = Index(self.docs.sparkSession, path, self.docs)
        return Collection(self.docs, self.annotations, self.params, index if index.whole() else Index.build(self.docs, path))

    def stats(self):
        """The statistics that rankers use (see stats.select)."""
        from .operators import stats

        return stats.select(self)

    def count_of(self, features: list[str]) -> dict[str, int]:
        """How often features stand in the collection, a row a feature of the list."""
        rows = self.index.counts(features) if self.index is not None and self.annotations is None else self.postings(features).groupBy("feature").agg(F.count("*").alias("count"))
        return {r.feature: r["count"] for r in rows.collect()}

    def lengths(self) -> DataFrame:
        if self.index is not None:
            return self.index.lengths()
        return self.docs.select("doc", F.size(T.ascii_words(F.col("text"))).cast("long").alias("length"))

    def bases(self, bits: int = 16) -> DataFrame:
        """(doc, base, length): where each document begins in one address space of all, in order of doc.

        Prefix sums in two levels: within runs of 2**bits consecutive ids, each a
        partition of its own, and over the runs' totals, a row a run.
        """
        from pyspark.sql import Window

        before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.lengths().withColumn("run", F.shiftright("doc", bits))
        runs = rows.groupBy("run").agg(F.sum("length").alias("total")).select("run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
        inner = Window.partitionBy("run").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
        within = rows.withColumn("inner", F.coalesce(F.sum("length").over(inner), F.lit(0)))
        return within.join(runs, "run").select("doc", (F.col("start") + F.col("inner")).alias("base"), "length")

    def globalize(self, intervals: DataFrame) -> DataFrame:
        """Intervals in the address space of all documents, as those of one document 0: operators on them cross documents, in one task."""
        at = intervals.join(self.bases().select("doc", "base"), "doc")
        return at.select(F.lit(0).cast("long").alias("doc"), (F.col("p") + F.col("base")).alias("p"), (F.col("q") + F.col("base")).alias("q"), "v", "n")

    def tokens(self) -> DataFrame:
        return T.tokens(self.docs, "doc", "text")

    def lines(self) -> DataFrame:
        """One interval, feature `line:`, for each line that has tokens; n is the line's number from 1."""
        from pyspark.sql import Window

        rows = self.docs.select("doc", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("doc", "k", F.size(T.ascii_words(F.col("line"))).cast("long").alias("c"))
        end = F.sum("c").over(Window.partitionBy("doc").orderBy("k"))
        rows = rows.withColumn("end", end).where("c > 0")
        return rows.select(F.lit("line:").alias("feature"), "doc", (F.col("end") - F.col("c")).alias("p"), (F.col("end") - 1).alias("q"), F.lit(0.0).alias("v"), (F.col("k") + 1).cast("long").alias("n"))

    def _holds(self, terms: list[str], need: int):
        """Texts that can hold `need` of the terms: a cheap test before tokens are taken apart."""
        hits = [F.lower("text").contains(t.lower()).cast("int") for t in terms]
        return reduce(lambda a, b: a + b, hits) >= need

    def _posting(self, terms: list[str], need: int) -> DataFrame:
        if self.index is not None:
            return self.index.postings(terms).select("feature", "doc", "p", F.col("p").alias("q"), F.lit(0.0).alias("v"), F.lit(None).cast("long").alias("n"))
        words = self.docs.where(self._holds(terms, need)).select("doc", F.posexplode(T.ascii_words(F.col("text"))).alias("p", "word"))
        words = words.where(F.lower("word").isin([t.lower() for t in terms]))
        rows = words.select("doc", F.col("p").cast("long").alias("p"), F.explode(T.ascii_features(F.col("word"))).alias("feature")).where(F.col("feature").isin(terms))
        return rows.select("feature", "doc", "p", F.col("p").alias("q"), F.lit(0.0).alias("v"), F.lit(None).cast("long").alias("n"))

    def postings(self, terms: list[str], need: int = 1) -> DataFrame:
        """(feature, doc, p, q, v, n) of several features, reduced per feature."""
        words = [t for t in terms if t.isalnum() and t.isascii()]
        parts = [self._posting(words, max(1, need - (len(set(terms)) - len(set(words)))))] if words else []
        if self.annotations is not None:
            parts.append(self.annotations.where(F.col("feature").isin(terms)))
        if not parts:
            return self.docs.sparkSession.createDataFrame([], ANNOTATION)
        return reduce(DataFrame.unionByName, parts)

    def term(self, feature: str) -> DataFrame:
        if self.annotations is None:  # tokens are width-1 and distinct already
            return self.postings([feature]).select(I.COLUMNS)
        return I.minimal(self.postings([feature]))

    def tagged_terms(self, terms: list[str], need: int) -> DataFrame:
        if self.annotations is not None and self.annotations.where(F.col("feature").isin(terms)).limit(1).count():
            return I.tagged([self.term(t) for t in terms])
        place: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            place.setdefault(t, []).append(i)
        tags = F.create_map(*[x for t, k in place.items() for x in (F.lit(t), F.array(*map(F.lit, k)))])
        bare = Collection(self.docs, index=self.index)
        return bare.postings(list(place), min(need, len(place))).withColumn("tag", F.explode(tags[F.col("feature")])).select(*I.COLUMNS, "tag")

    def gcl(self, query: str | X.Expr) -> DataFrame:
        """The intervals (doc, p, q, v, n) of a prefix query, rewritten by how often its terms stand in the collection where that can help."""
        e = X.expand_phrases(X.parse(query) if isinstance(query, str) else query, X.split_ascii)
        if self.params.get("optimize", True) and X.optimize(e, lambda _: 0, False) != e:
            counts = self.count_of(sorted(set(e.terms())))
            e = X.optimize(e, lambda t: counts.get(t, 0), False)
        return lower(e, self)

    def infix(self, query: str, session: X.Infix | None = None) -> DataFrame | None:
        """The intervals of an infix query; None for an assignment."""
        e = (session or X.Infix()).read(query)
        return None if e is None else self.gcl(e)

    def translate(self, intervals: DataFrame) -> DataFrame:
        """intervals with `content`: the characters from the start of token p to the start of token q + 1."""
        words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+[^A-Za-z0-9]*"), F.lit(0))
        joined = intervals.join(self.docs, "doc")
        return joined.withColumn("content", F.array_join(F.slice(words, F.col("p").cast("int") + 1, (F.col("q") - F.col("p") + 1).cast("int")), "")).drop("text")

    def counts(self) -> DataFrame:
        """(feature, count) of all tokens and annotations."""
        if self.index is not None:
            every = self.index.counts()
            if self.annotations is None:
                return every
            more = self.annotations.groupBy("feature").agg(F.count("*").alias("count"))
            return every.unionByName(more).groupBy("feature").agg(F.sum("count").alias("count"))
        every = self.tokens().select("feature")
        if self.annotations is not None:
            every = every.unionByName(self.annotations.select("feature"))
        return every.groupBy("feature").agg(F.count("*").alias("count"))
