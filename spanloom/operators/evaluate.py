"""Effectiveness metrics of runs (topic, doc, rank[, len]) against judgements (topic, doc, gain)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gains(qrels: DataFrame, exponential: bool = True) -> DataFrame:
    """gain of (topic, doc, grade): (2**g - 1) / 2**max or g / max; grades below 0 count as 0."""
    g = F.greatest(F.col("grade"), F.lit(0)).cast("double")
    top = qrels.agg(F.greatest(F.max("grade"), F.lit(1)).cast("double").alias("most"))
    gain = (F.pow(F.lit(2.0), g) - 1) / F.pow(F.lit(2.0), F.col("most")) if exponential else g / F.col("most")
    return qrels.crossJoin(F.broadcast(top)).withColumn("gain", gain).drop("most")  # top is one row


def docnos(collection, feature: str) -> DataFrame:
    """(docno, doc) of the document numbers that stand in a collection under a feature."""
    from ..functions import text as T

    return collection.translate(collection.term(feature)).select(T.docno(F.col("content")).alias("docno"), "doc")


def located(qrels: DataFrame, collection, feature: str) -> DataFrame:
    """qrels (topic, docno, ...) with the documents of their numbers, which are cleaned first; judgements of documents that aren't there drop out."""
    from ..functions import text as T

    return qrels.withColumn("docno", T.docno(F.col("docno"))).join(docnos(collection, feature), "docno")


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("topic", "doc", "gain"), ["topic", "doc"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


def precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per topic: ap, p05, p10, p20, rr, ret, rel, rel_ret, precision, recall."""
    w = Window.partitionBy("topic").orderBy("rank")
    j = _judged(run, qrels).withColumn("hit", (F.col("gain") > 0).cast("int")).withColumn("so_far", F.sum("hit").over(w))
    at = lambda k: (F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / k)
    per = j.groupBy("topic").agg(
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"), at(5).alias("p05"), at(10).alias("p10"), at(20).alias("p20"),
        F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"), F.count("*").alias("ret"), F.sum("hit").alias("rel_ret"),
    )
    rel = qrels.where("gain > 0").groupBy("topic").agg(F.count("*").alias("rel"))
    out = per.join(rel, "topic", "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    some = F.greatest("rel", F.lit(1))
    return out.select("topic", (F.col("ap_sum") / some).alias("ap"), "p05", "p10", "p20", "rr", "ret", "rel", "rel_ret", (F.col("rel_ret") / F.col("ret")).alias("precision"), (F.col("rel_ret") / some).alias("recall"))


def _dcg(gain, rank, k=None):
    x = gain * math.log(2.0) / F.log(rank + 1.0)
    return F.sum(x if k is None else F.when(rank <= k, x).otherwise(0.0))


def ndcg(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per topic: dcg, ndcg and both at 5, 10 and 20; the ideal ranks all judged documents."""
    cuts = [("", None), ("05", 5), ("10", 10), ("20", 20)]
    own = _judged(run, qrels).groupBy("topic").agg(*[_dcg(F.col("gain"), F.col("rank"), k).alias("dcg" + n) for n, k in cuts])
    ideal = qrels.where("gain > 0").withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("gain"), "doc")))
    ideal = ideal.groupBy("topic").agg(*[_dcg(F.col("gain"), F.col("rank"), k).alias("best" + n) for n, k in cuts])
    return own.join(ideal, "topic", "left").select("topic", *["dcg" + n for n, _ in cuts], *[F.coalesce(F.col("dcg" + n) / F.col("best" + n), F.lit(0.0)).alias("ndcg" + n) for n, _ in cuts])


def rbp(run: DataFrame, qrels: DataFrame) -> DataFrame:
    j = _judged(run, qrels)
    one = lambda p: ((1 - p) * F.sum(F.col("gain") * F.pow(F.lit(p), F.col("rank") - 1)))
    return j.groupBy("topic").agg(one(0.5).alias("rbp50"), one(0.95).alias("rbp95"))


def tbg(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Time-biased gain; run also has len, the documents' tokens."""
    click1, click0, save, summary, per_token, fixed, half = 0.64, 0.39, 0.77, 4.4, 0.018, 7.8, 224.0
    j = _judged(run, qrels)
    click = F.when(F.col("gain") > 0, click1).otherwise(click0)
    before = Window.partitionBy("topic").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(summary + (per_token * F.col("len") + fixed) * click).over(before), F.lit(0.0))
    j = j.withColumn("spent", spent)
    return j.groupBy("topic").agg(F.sum(F.when(F.col("gain") > 0, click1 * save * F.exp(-F.col("spent") * math.log(2.0) / half)).otherwise(0.0)).alias("tbg"))


def med(one: DataFrame, two: DataFrame) -> DataFrame:
    """Largest difference that judgements could make between two runs, per topic: med_dcg, med_ndcg, med_rbp50, med_rbp95."""
    a, b = one.select("topic", "doc", F.col("rank").alias("r1")), two.select("topic", "doc", F.col("rank").alias("r2"))
    both = a.join(b, ["topic", "doc"], "full")
    size = Window.partitionBy("topic")
    both = both.withColumns({"n1": F.count("r1").over(size), "n2": F.count("r2").over(size)})
    out = []
    for mine, other, n_mine in (("r1", "r2", "n1"), ("r2", "r1", "n2")):
        # a document is judged relevant by the side that shows it first; ties go to the one being maximised
        rel = F.col(mine).isNotNull() & (F.col(other).isNull() | (F.col(mine) <= F.col(other)))
        gain = F.when(rel, 1.0).otherwise(0.0)
        term = lambda f: F.sum(gain * (f(F.col(mine)) - F.when(F.col(other).isNotNull(), f(F.col(other))).otherwise(0.0)))  # noqa: B023, E731
        out.append([term(f) for f in (lambda r: math.log(2.0) / F.log(r + 1.0), lambda r: 0.5 * F.pow(F.lit(0.5), r - 1), lambda r: 0.05 * F.pow(F.lit(0.95), r - 1))])
    per = both.groupBy("topic").agg(*[F.greatest(x, y).alias(n) for x, y, n in zip(*out, ("med_dcg", "med_rbp50", "med_rbp95"))], F.greatest(F.max("n1"), F.max("n2")).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, r: s + math.log(2.0) / F.log(r + 1.0))
    return per.select("topic", "med_dcg", (F.col("med_dcg") / ideal).alias("med_ndcg"), "med_rbp50", "med_rbp95")


def mean(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in metrics.columns if c != "topic"])


def tune_best(trials: DataFrame) -> DataFrame:
    """(topic, trial, value): every topic's best trial, and below topic null its mean."""
    best = trials.groupBy("topic").agg(F.max_by("trial", F.struct("value", -F.col("trial"))).alias("trial"), F.max("value").alias("value"))
    return best


def bootstrap(trials: DataFrame, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """(trial, wins): how often a trial has the largest mean over topics drawn with replacement.

    Topics are drawn by MD5 sums, so a round is the same in every engine.
    """
    from .rank import uniform

    n_topics = trials.select("topic").distinct()
    numbered = n_topics.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("topic")) - 1)
    count = F.broadcast(numbered.agg(F.count("*").alias("m")))
    pick = F.floor(uniform(F.lit(seed), F.col("round"), F.col("k")) * F.col("m")).cast("long")
    draws = numbered.crossJoin(count).select("m", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), "k").withColumn("pick", pick)
    drawn = draws.join(numbered.select(F.col("k").alias("pick"), "topic"), "pick").join(trials, "topic")
    means = drawn.groupBy("round", "trial").agg(F.avg("value").alias("value"))
    return means.groupBy("round").agg(F.max_by("trial", F.struct(F.round("value", 12), -F.col("trial"))).alias("trial")).groupBy("trial").agg(F.count("*").alias("wins"))


def running_mean(scores: DataFrame, bits: int = 16) -> DataFrame:
    """scores (step, value), steps whole numbers, with the mean of the values so far.

    Prefix sums in two levels: within runs of 2**bits consecutive steps, each a
    partition of its own, and over the runs' totals, a row a run.
    """
    rows = scores.withColumn("run", F.shiftright("step", bits))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    runs = runs.select("run", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inner = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({"s1": F.sum("value").over(inner), "c1": F.count("value").over(inner)}).join(runs, "run")
    return within.withColumn("mean", (F.col("s0") + F.col("s1")) / (F.col("c0") + F.col("c1"))).drop("run", "s0", "s1", "c0", "c1")


def training_triples(topics: DataFrame, better: DataFrame, texts: DataFrame) -> DataFrame:
    """One tab-separated line "topic text, better text, worse text" for each preference (topic, doc, worse)."""
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    j = better.join(topics.select("topic", F.col("text").alias("question")), "topic").join(texts.select("doc", F.col("text").alias("one")), "doc")
    j = j.join(texts.select(F.col("doc").alias("worse"), F.col("text").alias("two")), "worse")
    return j.select("topic", "doc", "worse", F.concat_ws("\t", flat(F.col("question")), flat(F.col("one")), flat(F.col("two"))).alias("line"))
