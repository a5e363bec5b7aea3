"""The interval algebra as window sweeps.

An interval list is a DataFrame (doc, p, q, v, n): no interval of a document
contains another.  Every operator is one shuffle by doc (further ones on doc
reuse it) and a sort; none is a theta join.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["doc", "p", "q", "v", "n"]


def _up(*order, lo=Window.unboundedPreceding, hi=0, rows=False):
    w = Window.partitionBy("doc").orderBy(*order)
    return w.rowsBetween(lo, hi) if rows else w.rangeBetween(lo, hi)


def plain(df: DataFrame) -> DataFrame:
    """p and q with empty values."""
    return df.select("doc", "p", "q", F.lit(0.0).alias("v"), F.lit(None).cast("long").alias("n"))


def minimal(df: DataFrame, *tie: Column) -> DataFrame:
    """The intervals that contain no other; of equal ones the first by `tie`."""
    before = F.max("p").over(_up("q", F.desc("p"), *tie, hi=-1, rows=True))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("p") > F.col("_before"))).select(COLUMNS)


def tagged(lists: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, [x.select(*COLUMNS).withColumn("tag", F.lit(i)) for i, x in enumerate(lists)])


def merge(lists: list[DataFrame], last_wins: bool = True) -> DataFrame:
    """Minimal intervals of the union with their values; of equal intervals the last list's (the first's without last_wins)."""
    return minimal(tagged(lists), F.desc("tag") if last_wins else F.asc("tag"))


def one_of(lists: list[DataFrame]) -> DataFrame:
    return plain(minimal(fold(DataFrame.unionByName, lists)))


def n_of(n: int, m: int, union: DataFrame) -> DataFrame:
    """Smallest intervals that hold one of n different lists; union has a `tag` of 0 .. m - 1."""
    w = _up("q")
    last = [F.max(F.when(F.col("tag") == i, F.col("p"))).over(w) for i in range(m)]
    if n == m:
        at = F.when(fold(lambda a, b: a & b, [F.col(f"_{i}").isNotNull() for i in range(m)]), F.least(*[F.col(f"_{i}") for i in range(m)]) if m > 1 else F.col("_0"))
    else:
        at = F.get(F.sort_array(F.array(*[F.col(f"_{i}") for i in range(m)]), asc=False), F.lit(n - 1))
    swept = union.select("doc", "q", *[x.alias(f"_{i}") for i, x in enumerate(last)]).select("doc", "q", at.alias("p")).where("p is not null")
    return plain(swept.groupBy("doc", "p").agg(F.min("q").alias("q")))


def all_of(lists: list[DataFrame]) -> DataFrame:
    return n_of(len(lists), len(lists), tagged(lists))


def followed_by(a: DataFrame, b: DataFrame) -> DataFrame:
    """Smallest intervals from the start of one of a to the end of one of b that begins after it."""
    null = F.lit(None).cast("long")
    events = a.select("doc", F.col("q").alias("at"), F.col("p").alias("ap"), null.alias("bq")).unionByName(b.select("doc", F.col("p").alias("at"), null.alias("ap"), F.col("q").alias("bq")))
    swept = events.withColumn("p", F.max("ap").over(_up("at", hi=-1))).where("bq is not null and p is not null")
    return plain(swept.groupBy("doc", "p").agg(F.min("bq").alias("q")))


def _filter(a: DataFrame, b: DataFrame, inside: bool, keep: bool) -> DataFrame:
    """a's with (keep) or without a b around them (inside) or in them."""
    by, other = ("q", "p") if inside else ("p", "q")
    both = a.select(*COLUMNS, F.lit(True).alias("mine")).unionByName(plain(b).withColumn("mine", F.lit(False)))
    near = F.min(F.when(~F.col("mine"), F.col(other))).over(_up(F.desc(by)))  # backwards: a frame that looks ahead is computed anew for each row
    hit = F.coalesce(F.col("_near") <= F.col(other), F.lit(False))
    return both.withColumn("_near", near).where(F.col("mine") & (hit if keep else ~hit)).select(COLUMNS)


def contained_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return _filter(a, b, True, True)


def containing(a: DataFrame, b: DataFrame) -> DataFrame:
    return _filter(a, b, False, True)


def not_contained_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return _filter(a, b, True, False)


def not_containing(a: DataFrame, b: DataFrame) -> DataFrame:
    return _filter(a, b, False, False)


def link(a: DataFrame) -> DataFrame:
    """The addresses that integer payloads point to."""
    return plain(a.where("n is not null").select("doc", F.col("n").alias("p"), F.col("n").alias("q")).distinct())


def phrase(union: DataFrame, m: int) -> DataFrame:
    """Intervals of m consecutive tokens, the i-th of list i; union has a `tag`."""
    starts = union.groupBy("doc", (F.col("p") - F.col("tag")).alias("p")).agg(F.count_distinct("tag").alias("hits")).where(F.col("hits") == m)
    return plain(starts.select("doc", "p", (F.col("p") + m - 1).alias("q")))


def width(a: DataFrame, condition) -> DataFrame:
    """a's whose number of tokens meets the condition (Column to Column)."""
    return a.where(condition(F.col("q") - F.col("p") + 1))


def windows_in(a: DataFrame, n: int, lengths: DataFrame) -> DataFrame:
    """Windows of n tokens that contain one of a, within their documents."""
    out = width(a, lambda w: w <= n).join(lengths, "doc").select("doc", "length", F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - (n - 1)), F.col("p"))).alias("p"))
    return plain(out.where(F.col("p") + n <= F.col("length")).select("doc", "p", (F.col("p") + n - 1).alias("q")).distinct())


def windows_inside(a: DataFrame, n: int) -> DataFrame:
    """Windows of n tokens that one of a contains."""
    out = width(a, lambda w: w >= n).select("doc", F.explode(F.sequence(F.col("p"), F.col("q") - (n - 1))).alias("p"))
    return plain(out.select("doc", "p", (F.col("p") + n - 1).alias("q")).distinct())


def all_windows(lengths: DataFrame, n: int) -> DataFrame:
    return windows_inside(lengths.where("length > 0").select("doc", F.lit(0).cast("long").alias("p"), (F.col("length") - 1).alias("q")), n)


def probe(a: DataFrame, keys: DataFrame, method: str) -> DataFrame:
    """For each (doc, k) of keys the interval that a cursor method finds: tau (first with p >= k), rho (first with q >= k), uat (last with q <= k), ohr (last with p <= k).

    An as-of join by union and one window; keys without an answer have null p, q.
    """
    by = "p" if method in ("tau", "ohr") else "q"
    both = a.select("doc", F.col(by).alias("at"), F.struct("p", "q", "v", "n").alias("hit"), F.lit(None).cast("long").alias("k"))
    both = both.unionByName(keys.select("doc", F.col("k").alias("at"), F.lit(None).cast(both.schema["hit"].dataType).alias("hit"), "k"))
    if method in ("tau", "rho"):
        found = F.last("hit", ignorenulls=True).over(_up(F.desc("at")))
    else:
        found = F.last("hit", ignorenulls=True).over(_up("at"))
    return both.withColumn("hit", found).where("k is not null").select("doc", "k", "hit.p", "hit.q", "hit.v", "hit.n")
