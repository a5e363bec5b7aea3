"""Term and collection statistics: computed from texts, stored, or read from annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


#: Bytes of texts whose matches one task scores, about, and texts of that many bytes are of unknown size.
PART_BYTES, UNKNOWN_BYTES = 4 << 20, 1 << 50


def words(docs: DataFrame) -> DataFrame:
    """(doc, len, words) of (doc, text): split words, computed in the scan."""
    w = docs.select("doc", T.ascii_split(F.col("text")).alias("words"))
    return w.select("doc", F.size("words").cast("long").alias("len"), "words")


def tf(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc, len, term, tf); terms: (term), a checked-size list that is broadcast, keeps the explosion to what a query asks for."""
    rows = words(docs)
    few = None if terms is None else few_of(terms)
    if few:  # other words aren't counted
        rows = rows.select("doc", "len", F.filter("words", lambda w: w.isin(few)).alias("words"))
    rows = T.counted(rows, "words", "term", "tf").select("doc", "len", "term", "tf")
    if terms is not None:
        rows = rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return rows


def few_of(terms: DataFrame, most: int = 1000) -> list[str] | None:
    """The distinct terms of a table, None where they are more than `most`."""
    found = [r.term for r in terms.select("term").distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def df(docs: DataFrame) -> DataFrame:
    """(term, df): documents that hold a term."""
    return docs.select(F.explode(F.array_distinct(T.ascii_split(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def totals(docs: DataFrame) -> DataFrame:
    """One row: items, length, avgl."""
    t = words(docs).where("len > 0").agg(F.count("*").alias("items"), F.coalesce(F.sum("len"), F.lit(0)).alias("length"))
    return t.withColumn("avgl", F.col("length") / F.greatest("items", F.lit(1)))


def idf(n, d):
    return F.greatest(F.log(n / d), F.lit(0.0))


def rsj(n, d):
    """The weight of a term that d of n items hold; 0 where it would be negative."""
    return F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(0.0))


def icf(tokens_and_vocabulary, count):
    return F.log(tokens_and_vocabulary / (count + 1.0))


def term_counts(docs: DataFrame) -> DataFrame:
    """(feature, count): every feature of every token."""
    return T.tokens(docs, "doc", "text").groupBy("feature").agg(F.count("*").alias("count"))


def field_tf(fields: dict[str, DataFrame]) -> DataFrame:
    """(doc, term, field, tf) of several (doc, text) tables."""
    out = None
    for name, docs in fields.items():
        one = tf(docs).select("doc", "term", F.lit(name).alias("field"), "tf")
        out = one if out is None else out.unionByName(one)
    return out


class Stats:
    """What rankers ask of a collection; this kind computes it from (doc, text) when asked."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def tf(self, terms: DataFrame | None = None) -> DataFrame:
        """(doc, len, term, tf); terms: a table of checked size."""
        return tf(self.docs, terms)

    def weights(self, own: DataFrame, terms: DataFrame | None = None) -> DataFrame:
        """(term, df, ctf): documents that hold a term, and its occurrences. own: what tf(terms) gave."""
        return own.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))

    def df(self, terms: DataFrame, is_small: bool = False) -> DataFrame:
        """(term, df) of the terms of a table of any size; is_small: of checked size."""
        return df(self.docs).join(terms.select("term").distinct(), "term", "left_semi")

    def parts(self) -> int:
        """Partitions by document of what a query matches: they grow with the texts, so that what a task holds doesn't."""
        spark = self.docs.sparkSession
        size = int(str(self.docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        more = int(spark.conf.get("spark.sql.shuffle.partitions")) if size >= UNKNOWN_BYTES else size // PART_BYTES
        return max(spark.sparkContext.defaultParallelism, more)

    def matches(self, terms: DataFrame | None = None) -> DataFrame:
        """tf(terms) with a document's rows in one partition: what is scored by document needs no further shuffle."""
        return self.tf(terms).repartition(self.parts(), "doc")

    def split_words(self) -> DataFrame:
        """(word): the distinct split words."""
        return self.docs.select(F.explode(F.array_distinct(T.ascii_split(F.col("text")))).alias("word")).distinct()

    def totals(self) -> DataFrame:
        return totals(self.docs)

    def counts(self) -> DataFrame:
        """(feature, count)."""
        return term_counts(self.docs)

    def vocabulary(self) -> DataFrame:
        """One row: vocab, the number of features."""
        return self.counts().agg(F.count("*").alias("vocab"))

    def words(self, chosen: DataFrame) -> DataFrame:
        """(doc, len, words) of the documents of a table of checked size: no other text is taken apart."""
        return words(self.docs.join(F.broadcast(chosen.select("doc").distinct()), "doc", "left_semi"))


class AnnotatedStats(Stats):
    """Statistics that a forager left as annotations tf:term (n: the frequency, at the item's start) and df:term (n: the items)."""

    def __init__(self, collection, tag: str = ""):
        super().__init__(collection.docs)
        self.rows, self.prefix = collection.annotations, f"{tag}:" if tag else ""

    def _of(self, kind: str) -> DataFrame:
        start = f"{self.prefix}{kind}:"
        return self.rows.where(F.col("feature").startswith(start)).withColumn("term", F.substring("feature", len(start) + 1, 1 << 30))

    def tf(self, terms: DataFrame | None = None) -> DataFrame:
        rows = self._of("tf").select("doc", "term", F.col("n").alias("tf"))
        rows = rows if terms is None else rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        per_doc = rows.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
        return per_doc.join(words(self.docs).select("doc", "len"), "doc").select("doc", "len", "term", "tf")


def of(source) -> Stats:
    """The Stats of a (doc, text) table; a Stats stays as it is."""
    return source if isinstance(source, Stats) else Stats(source)


def select(collection, params: dict | None = None) -> Stats:
    """Stats by the parameter `statistics` (text, index or tf-idf, with tf-idf:tag for a forager's tag), or, without it, the stored ones if there are any."""
    name = (params or collection.params or {}).get("statistics") or ("index" if collection.index is not None else "text")
    kind, _, tag = str(name).partition(":")
    if kind == "text":
        return Stats(collection.docs)
    if kind == "index":
        if collection.index is None:
            raise ValueError("the collection has no stored index")
        return collection.index
    if kind in ("tf-idf", "tf_idf"):
        if collection.annotations is None:
            raise ValueError("the collection has no annotations")
        return AnnotatedStats(collection, tag)
    raise ValueError(f"unknown statistics {name}")


def df_difference(index: DataFrame, one: Stats, two: Stats) -> DataFrame:
    """(term, one, two): terms of a list whose document frequencies differ between two sources, 0 where a source lacks the term."""
    a, b = one.df(index).withColumnRenamed("df", "one"), two.df(index).withColumnRenamed("df", "two")
    both = a.join(b, "term", "full").select("term", F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("two", F.lit(0)).alias("two"))
    return both.where("one <> two")
