"""Ranking models, fusion and feedback over (doc, text) tables or stored statistics.

Queries are (topic, term, w); results (topic, doc, score, rank), scores rounded
to DIGITS digits so that ties are ties everywhere, and broken by doc.  Query
terms are broadcast behind a check of their number and size.  Where a function
takes `docs`, a stats.Stats, as a stored index is, may stand in its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..model import Collection
from . import intervals as I
from . import stats as S

DIGITS = 6
DEFAULTS = {"bm25": {"b": 0.25, "k1": 0.5}, "lmd": {"mu": 2000.0}, "ssr": {"K": 42.0}, "rsj": {"expansions": 25, "depth": 10, "gamma": 0.2}, "kld": {"expansions": 8, "depth": 16, "window": 64, "gamma": 1 / 3}, "tiered": {"delta": 1.0}, "qap": {"depth": 5, "length": 64, "passages": 32, "window": 64}}
#: Ranges that parameters are drawn from when tuning: (least, most, whether on a log scale).
RANGES = {"bm25": {"b": (0.0, 1.0, False), "k1": (0.01, 1000.0, True)}, "lmd": {"mu": (100.0, 10000.0, False)}, "ssr": {"K": (1.0, 1000.0, True)}, "tiered": {"delta": (0.0, 10.0, False)}}
DEPTH = 1000
#: Rows and bytes of a table that is broadcast at most; a larger one joins by shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: The stop list of the "stop" stage.
STOPWORDS = "a an and are as at be by for from has he in is it its of on or she that the this to was were what when where which who will with".split()


def param(model: str, name: str, given: dict | None) -> float:
    """model:name, then name, of the given parameters, then the default."""
    given = given or {}
    return given.get(f"{model}:{name}", given.get(name, DEFAULTS[model][name]))


def random_params(model: str, trials: int, seed: int = 0) -> list[dict[str, float]]:
    """Parameters of a model drawn at random, the same for the same seed; the first trial is the default."""
    import math
    import random

    rng = random.Random(f"{model}:{seed}")
    draw = lambda lo, hi, log: math.exp(rng.uniform(math.log(lo), math.log(hi))) if log else rng.uniform(lo, hi)
    return [dict(DEFAULTS[model]), *({k: draw(*r) for k, r in RANGES[model].items()} for _ in range(trials - 1))][:trials]


def settle(df: DataFrame) -> tuple[DataFrame, bool]:
    """(df, whether it is small): a small table is computed once and stands in the plan as rows, a larger one is written to the shared folder."""
    rows = df.limit(BROADCAST_TERMS + 1).toArrow()
    if rows.num_rows <= BROADCAST_TERMS and rows.nbytes <= BROADCAST_BYTES:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return shared.materialize(df, "ranking"), False


def small(df: DataFrame) -> DataFrame:
    """df, computed once, with a broadcast hint if it is small."""
    return _hint(*settle(df))


def _hint(df: DataFrame, is_small: bool) -> DataFrame:
    """A broadcast hint for a table with at most as many rows as one that was found small."""
    return F.broadcast(df) if is_small else df


def top(scores: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The first `depth` of each topic; scores of 0 or less drop out."""
    s = scores.withColumn("score", F.round("score", DIGITS)).where("score > 0")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= depth)


def topics(df: DataFrame, id_col: str, text_col: str, words: int | None = None) -> DataFrame:
    """Queries from texts: their distinct split words, or those of the first `words`, each of weight 1."""
    from ..functions.text import ascii_split

    w = ascii_split(F.col(text_col))
    w = F.slice(w, 1, words) if words else w
    return df.select(F.col(id_col).cast("long").alias("topic"), F.explode(F.array_distinct(w)).alias("term")).withColumn("w", F.lit(1.0))


def bm25(docs: DataFrame, queries: DataFrame, params: dict | None = None, depth: int = DEPTH, tf: DataFrame | None = None) -> DataFrame:
    """tf: (doc, len, term, tf), a document's rows in one partition, to use in place of the documents' own words."""
    b, k1 = param("bm25", "b", params), param("bm25", "k1", params)
    stats = S.of(docs)
    queries, is_small = settle(queries)
    terms = queries if is_small else None
    n = F.broadcast(stats.totals())  # one row
    if tf is None:
        tf = stats.matches(terms)
        weight = stats.weights(tf, terms)
    else:
        weight = S.Stats.weights(stats, tf)
    if not is_small:
        weight = weight.join(queries.select("term").distinct(), "term", "left_semi")
    weight = weight.crossJoin(n).select("term", "avgl", S.rsj(F.col("items"), F.col("df")).alias("rsj")).where("rsj > 0")
    norm = k1 * ((1 - b) + b * F.col("len") / F.col("avgl"))
    score = F.sum(F.col("w") * F.col("rsj") * F.col("tf") / (norm + F.col("tf")))
    m = tf.join(_hint(weight, is_small), "term").join(_hint(queries, is_small), "term")
    return top(m.groupBy("topic", "doc").agg(score.alias("score")), depth)


def bm25_trials(docs, queries: DataFrame, trials: list[dict], depth: int = DEPTH) -> DataFrame:
    """(trial, topic, doc, score, rank) of BM25 for several parameters at once: matches are read once, and scored for every trial."""
    stats = S.of(docs)
    queries, is_small = settle(queries)
    terms = queries if is_small else None
    tf = stats.matches(terms)
    weight = stats.weights(tf, terms).crossJoin(F.broadcast(stats.totals())).select("term", "avgl", S.rsj(F.col("items"), F.col("df")).alias("rsj")).where("rsj > 0")
    m = tf.join(_hint(weight, is_small), "term").join(_hint(queries, is_small), "term")

    def score(p: dict) -> Column:
        b, k1 = float(param("bm25", "b", p)), float(param("bm25", "k1", p))
        norm = F.lit(k1) * ((1 - F.lit(b)) + F.lit(b) * F.col("len") / F.col("avgl"))
        return F.round(F.sum(F.col("w") * F.col("rsj") * F.col("tf") / (norm + F.col("tf"))), DIGITS)

    every = m.groupBy("topic", "doc").agg(F.array(*[score(p) for p in trials]).alias("x"))
    s = every.select("topic", "doc", F.posexplode("x").alias("trial", "score")).where("score > 0").select("trial", "topic", "doc", "score")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("trial", "topic").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= depth)


def lmd(docs: DataFrame, queries: DataFrame, params: dict | None = None, depth: int = DEPTH) -> DataFrame:
    """Dirichlet-smoothed language model over matching terms; results may have scores below 0, so they are not cut there."""
    mu, stats = param("lmd", "mu", params), S.of(docs)
    queries, is_small = settle(queries)
    terms = queries if is_small else None
    tf = stats.matches(terms)
    n = F.broadcast(stats.totals().select(F.col("length").alias("tokens")))  # one row
    ctf = stats.weights(tf, terms).select("term", "ctf").crossJoin(n)
    m = tf.join(_hint(queries, is_small), "term")
    s = F.sum(F.col("w") * (F.log(mu + F.col("tf") * F.col("tokens") / F.col("ctf")) - F.log(mu + F.col("len"))))
    s = m.join(_hint(ctf, is_small), "term").groupBy("topic", "doc").agg(F.round(s, DIGITS).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= depth)


def bm25f(fields: dict[str, DataFrame], weights: dict[str, float], queries: DataFrame, params: dict | None = None, depth: int = DEPTH) -> DataFrame:
    """BM25 over the weighted sum of field frequencies; a field of weight 0 drops out, a negative weight is an error."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("a field weight is negative")
    used, every = {f: d for f, d in fields.items() if weights.get(f)}, None
    queries, is_small = settle(queries)
    for f, d in used.items():
        one = S.tf(d, queries if is_small else None).select("doc", "term", (F.col("tf") * weights[f]).alias("tf"))
        every = one if every is None else every.unionByName(one)
    lens = None
    for d in fields.values():
        one = S.words(d).select("doc", "len")
        lens = one if lens is None else lens.unionByName(one)
    lens = lens.groupBy("doc").agg(F.sum("len").alias("len"))
    m = every.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    b, k1 = param("bm25", "b", params), param("bm25", "k1", params)
    n = F.broadcast(lens.where("len > 0").agg(F.count("*").alias("items"), F.avg("len").alias("avgl")))
    weight = m.groupBy("term").agg(F.count("*").alias("df")).crossJoin(n).select("term", "avgl", S.rsj(F.col("items"), F.col("df")).alias("rsj")).where("rsj > 0")
    score = F.sum(F.col("w") * F.col("rsj") * F.col("tf") / (k1 * ((1 - b) + b * F.col("len") / F.col("avgl")) + F.col("tf")))
    return top(m.join(_hint(queries, is_small), "term").join(_hint(weight, is_small), "term").join(lens, "doc").groupBy("topic", "doc").agg(score.alias("score")), depth)


def product(vectors: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Dot products of sparse vectors: vectors (doc, term, v), queries (topic, term, w)."""
    return top(vectors.join(small(queries), "term").groupBy("topic", "doc").agg(F.sum(F.col("w") * F.col("v")).alias("score")), depth)


def rrf(runs: list[DataFrame], k: int = 60, depth: int = DEPTH) -> DataFrame:
    every = None
    for r in runs:
        r = r.select("topic", "doc", "rank")
        every = r if every is None else every.unionByName(r)
    return top(every.groupBy("topic", "doc").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score")), depth)


def covers_in(collection: Collection, query, containers: DataFrame | None = None) -> DataFrame:
    """(doc, cp, cq, p, q): covers of a query with the container that encloses them (the document where none is given)."""
    covers = collection.gcl(query)
    if containers is None:
        return covers.select("doc", F.lit(0).cast("long").alias("cp"), F.lit(None).cast("long").alias("cq"), "p", "q")
    found = I.probe(containers, covers.select("doc", F.col("q").alias("k")), "rho").select("doc", F.col("k").alias("q"), F.col("p").alias("cp"), F.col("q").alias("cq"))
    return covers.join(found, ["doc", "q"]).where("cp <= p").select("doc", "cp", "cq", "p", "q")


def ssr(collection: Collection, query, containers: DataFrame | None = None, params: dict | None = None, depth: int = DEPTH, start: int | None = None, end: int | None = None, topic: int = 0) -> DataFrame:
    """Shortest-substring ranking: (topic, doc, cp, p, q, score, rank); p and q are the shortest, then first cover.

    start, end: only covers within these token positions [start, end).
    """
    c = covers_in(collection, query, containers)
    if start is not None:
        c = c.where(F.col("p") >= start)
    if end is not None:
        c = c.where(F.col("q") < end)
    best = F.min_by(F.struct("p", "q"), F.struct(F.col("q") - F.col("p"), "p"))
    s = c.groupBy("doc", "cp").agg(best.alias("best"), F.sum(1 / (param("ssr", "K", params) + F.col("q") - F.col("p"))).alias("score"))
    s = s.select(F.lit(topic).cast("long").alias("topic"), "doc", "cp", "best.p", "best.q", F.round("score", DIGITS).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "doc", "cp"))).where(F.col("rank") <= depth)


def tiered(collection: Collection, tiers: list, containers: DataFrame | None = None, params: dict | None = None, depth: int = DEPTH) -> DataFrame:
    """Tiers in order; a container ranks in the first tier that finds it, by its score there."""
    every = None
    for i, t in enumerate(tiers):
        one = ssr(collection, t, containers, params, depth).select(F.lit(i).alias("tier"), "doc", "cp", "p", "q", "score")
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("doc", "cp").agg(F.min_by(F.struct("p", "q", "score"), "tier").alias("x"), F.min("tier").alias("tier")).select("doc", "cp", "tier", "x.*")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", F.desc("score"), "doc", "cp"))).where(F.col("rank") <= depth)


def build_tiers(collection: Collection, query: str, params: dict | None = None, most: int = 16) -> list[str]:
    """Tiers of a bag of words: subsets of its `most` rarest terms by falling weight, those within delta of a tier's first together."""
    import math

    from ..plans.expr import split_ascii

    delta = param("tiered", "delta", params)
    terms = list(dict.fromkeys(split_ascii(query)))
    if not terms:
        return []
    stats = collection.stats()
    vocab, length = stats.vocabulary().first()[0], stats.totals().first().length
    counts = collection.count_of(terms)
    weight = {t: math.log((length + vocab) / (counts.get(t, 0) + 1)) for t in terms}
    terms = sorted(terms, key=lambda t: (-weight[t], t))[:most]
    subsets = []
    for m in range((1 << len(terms)) - 1, 0, -1):
        own = [t for j, t in enumerate(terms) if m >> j & 1]
        subsets.append((sum(weight[t] for t in own), f"(^ {' '.join(own)})" if len(own) > 1 else f"(... {own[0]} {own[0]})"))
    subsets.sort(key=lambda x: -x[0])
    tiers: list[list] = []
    for w, s in subsets:
        if tiers and tiers[-1][0] - w < delta:
            tiers[-1][1].append(s)
        else:
            tiers.append([w, [s]])
    return [s[0] if len(s) == 1 else f"(+ {' '.join(s)})" for _, s in tiers]


def icover(collection: Collection, terms: list[str], weights: dict[str, float], depth: int = DEPTH) -> DataFrame:
    """Passages: for each n the minimal covers of n of the terms, scored by their terms' weights less n log width; the best of a document stays."""
    m = len(terms)
    union = collection.tagged_terms(terms, 1)
    w = Window.partitionBy("doc").orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    last = [F.struct(F.max(F.when(F.col("tag") == i, F.col("p"))).over(w).alias("p"), F.lit(float(weights[t])).alias("w")) for i, t in enumerate(terms)]
    swept = union.select("doc", "q", F.filter(F.sort_array(F.array(*last), asc=False), lambda x: x["p"].isNotNull()).alias("near"))
    each = swept.select("doc", "q", "near", F.explode(F.sequence(F.lit(1), F.least(F.size("near"), F.lit(m)))).alias("k"))
    own = F.slice("near", F.lit(1), F.col("k"))
    each = each.select("doc", "q", "k", F.get("near", F.col("k") - 1)["p"].alias("p"), F.aggregate(own, F.lit(0.0), lambda a, x: a + x["w"]).alias("w"))
    covers = each.groupBy("doc", "k", "p").agg(F.min(F.struct("q", "w")).alias("x")).select("doc", "k", "p", "x.q", (F.col("x.w") - F.col("k") * F.log(F.col("x.q") - F.col("p") + 1)).alias("score"))
    best = covers.groupBy("doc").agg(F.max_by(F.struct("p", "q", "score"), F.struct(F.round("score", DIGITS), -F.col("k"), -F.col("p"))).alias("x")).select(F.lit(0).alias("topic"), "doc", "x.*")
    return top(best, depth)


def _expand(queries: DataFrame, extra: DataFrame) -> DataFrame:
    return queries.unionByName(extra.select("topic", "term", "w")).groupBy("topic", "term").agg(F.sum("w").alias("w"))


def _feedback_terms(docs: DataFrame, run: DataFrame, depth: int) -> DataFrame:
    """(topic, term, len) for the distinct words of each topic's first documents."""
    chosen, is_small = settle(run.where(F.col("rank") <= depth).select("topic", "doc"))
    return _words_of(docs, chosen, is_small).join(_hint(chosen, is_small), "doc").select("topic", "len", F.explode(F.array_distinct("words")).alias("term"))


def _words_of(docs, chosen: DataFrame, is_small: bool) -> DataFrame:
    """(doc, len, words) of chosen documents: other texts aren't taken apart if they are few."""
    stats = S.of(docs)
    return stats.words(chosen) if is_small else S.words(stats.docs)


def _best(terms: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.desc("tsv"), "term")
    return terms.withColumn("tsv", F.round("tsv", DIGITS)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rsj_feedback(docs: DataFrame, run: DataFrame, params: dict | None = None) -> DataFrame:
    """(topic, term, tsv, rank): expansion terms by their number of feedback documents times their weight."""
    f = _feedback_terms(docs, run, int(param("rsj", "depth", params))).groupBy("topic", "term").agg(F.count("*").alias("f"))
    stats = S.of(docs)
    f, is_small = settle(f)
    n = F.broadcast(stats.totals().select("items"))
    scored = stats.df(f, is_small).join(_hint(f, is_small), "term").crossJoin(n).select("topic", "term", (F.col("f") * S.rsj(F.col("items"), F.col("df"))).alias("tsv")).where("tsv > 0")
    return _best(scored, int(param("rsj", "expansions", params)))


def kld_feedback(docs: DataFrame, run: DataFrame, params: dict | None = None) -> DataFrame:
    """Expansion terms found in more feedback documents than their share of the collection lets expect."""
    f = small(_feedback_terms(docs, run, int(param("kld", "depth", params))))  # the counts of all features aren't shuffled for its few
    counts, total = _counts(docs)
    prob = (F.col("count") + 1) / (F.col("length") + F.col("vocab"))
    e = f.join(counts.withColumnRenamed("feature", "term"), "term").crossJoin(total).groupBy("topic", "term").agg(F.count("*").alias("f"), F.sum(1 - F.pow(1 - prob, F.col("len"))).alias("e"))
    return _best(e.where("f > 1").select("topic", "term", (F.col("f") * F.log(F.col("f") / F.col("e"))).alias("tsv")), int(param("kld", "expansions", params)))


def _counts(docs) -> tuple[DataFrame, DataFrame]:
    """(feature, count), and one row with length and vocab, to be broadcast."""
    stats = S.of(docs)
    return stats.counts(), F.broadcast(stats.vocabulary().crossJoin(stats.totals().select("length")))


def qa_feedback(collection: Collection, run: DataFrame, params: dict | None = None) -> DataFrame:
    """Like kld_feedback over the words within `window` of each cover, at their distance from it; run is ssr()'s."""
    depth, window = int(param("kld", "depth", params)), int(param("kld", "window", params))
    chosen, is_small = settle(run.where(F.col("rank") <= depth).select("topic", "doc", "p", "q"))
    near = _words_of(collection.stats(), chosen, is_small).join(_hint(chosen, is_small), "doc").select("topic", "doc", "p", "q", F.posexplode("words").alias("at", "term"))
    near = near.where((F.col("at") >= F.col("p") - window) & (F.col("at") <= F.col("q") + window))
    gap = F.when(F.col("at") < F.col("p"), F.col("q") - F.col("at")).when(F.col("at") > F.col("q"), F.col("at") - F.col("p") - 1).otherwise(F.col("q") - F.col("p") + 1)
    near = near.groupBy("topic", "doc", "term").agg(F.min(gap).alias("gap"))
    counts, total = _counts(collection.stats())
    prob = (F.col("count") + 1) / (F.col("length") + F.col("vocab"))
    e = near.join(counts.withColumnRenamed("feature", "term"), "term").crossJoin(total).groupBy("topic", "term").agg(F.count("*").alias("f"), F.sum(1 - F.pow(1 - prob, F.greatest("gap", F.lit(1)))).alias("e"))
    return _best(e.where("f > 1").select("topic", "term", (F.col("f") * F.log(F.col("f") / F.col("e"))).alias("tsv")), int(param("kld", "expansions", params)))


def qap(collection: Collection, terms: list[str], weights: dict[str, float], params: dict | None = None) -> DataFrame:
    """Answers: of the passages around the best covers, the `length`-word snippet with the largest sum of word weights.

    A word's weight is the cube of the sum, over passages, of log(N / (count *
    (distance from the cover + 1))); query words weigh nothing.
    """
    depth, length, passages, window = (int(param("qap", k, params)) for k in ("depth", "length", "passages", "window"))
    chosen, is_small = settle(icover(collection, terms, weights, passages).select("doc", "p", "q", "rank"))
    w = _words_of(collection.stats(), chosen, is_small).join(_hint(chosen, is_small), "doc")
    lo, hi = F.greatest(F.col("p") - window, F.lit(0)), F.least(F.col("q") + window, F.col("len") - 1)
    passage = w.select("doc", "rank", "p", "q", lo.alias("lo"), F.slice("words", (lo + 1).cast("int"), (hi - lo + 1).cast("int")).alias("words"))
    each = passage.select("doc", "rank", "lo", "p", "q", F.posexplode("words").alias("k", "term"))
    at = F.col("lo") + F.col("k")
    gap = F.when(at < F.col("p"), F.col("p") - at).when(at > F.col("q"), at - F.col("q")).otherwise(F.lit(0))
    near = each.groupBy("doc", "term").agg(F.min(gap).alias("gap"))
    counts, total = _counts(collection.stats())
    weight = near.join(counts.withColumnRenamed("feature", "term"), "term").crossJoin(total).groupBy("term").agg(F.sum(F.log((F.col("length") + F.col("vocab")) / ((F.col("count") + 1) * (F.col("gap") + 1)))).alias("w"))
    weight = small(weight.where(~F.col("term").isin(terms)).select("term", F.pow("w", 3).alias("w")))
    starts = passage.select("doc", "rank", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))).alias("s"))
    snippet = starts.select("doc", "rank", "s", F.slice("words", F.col("s") + 1, F.lit(length)).alias("snippet"))
    scored = snippet.select("doc", "rank", "s", "snippet", F.explode(F.array_distinct("snippet")).alias("term")).join(weight, "term", "left").groupBy("doc", "rank", "s").agg(F.first("snippet").alias("snippet"), F.round(F.sum(F.coalesce("w", F.lit(0.0))), DIGITS).alias("score"))
    best = scored.groupBy("doc").agg(F.max_by(F.struct("s", "snippet", "score"), F.struct("score", -F.col("s"))).alias("x")).select("doc", F.array_join("x.snippet", " ").alias("snippet"), "x.score")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= depth)


def uniform(*parts) -> Column:
    """A number from 0 to 1 made of the first 8 digits of an MD5 sum, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / (1 << 32)


def random_ranking(docs, seed: int = 0, depth: int = DEPTH) -> DataFrame:
    return top(S.of(docs).docs.select(F.lit(0).cast("long").alias("topic"), "doc", uniform(F.lit(seed), F.col("doc")).alias("score")), depth)


#: Further stages by name: functions (docs or Stats, queries, run, params) to (queries, run).
STAGES: dict[str, Callable] = {}


def stage(name: str):
    """Register a function as a stage of pipeline()."""

    def add(f: Callable) -> Callable:
        STAGES[name] = f
        return f

    return add


def pipeline(docs, queries: DataFrame, stages: str, params: dict | None = None, depth: int = DEPTH) -> DataFrame:
    """Stages in turn: stop, stem, bm25, lmd, rsj, kld, random, name=value and those of STAGES; a later ranking replaces an earlier one.

    What one stage hands to the next is computed once (see settle()).
    """
    params, run, q = dict(params or {}), None, queries
    for stage in stages.split():
        if "=" in stage:
            name, value = stage.split("=", 1)
            params[name] = float(value)
        elif stage == "stop":
            left = q.where(~F.col("term").isin(STOPWORDS))
            whole = q.join(left.select("topic").distinct(), "topic", "left_anti")  # all of the query is stop words: keep it
            q = left.unionByName(whole)
        elif stage == "stem":
            from ..functions.stem import stem_vocabulary

            stats, own = S.of(docs), q.select(F.col("term").alias("word")).distinct()
            stems = small(stem_vocabulary(own).select("stem").distinct())
            variants, is_small = settle(stem_vocabulary(stats.split_words().unionByName(own)).join(stems, "stem"))
            words = variants.select(F.col("word").alias("term"), "stem")
            tf = stats.matches(words if is_small else None).join(_hint(words, is_small), "term")
            if not is_small:
                tf = tf.repartition(stats.parts(), "doc")
            tf = tf.groupBy("doc", "len", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
            params["_tf"] = tf
            q = q.join(variants.withColumnRenamed("word", "term"), "term").groupBy("topic", F.col("stem").alias("term")).agg(F.sum("w").alias("w"))
        elif stage == "bm25":
            tf = params.get("_tf")
            run = settle(bm25(docs, q, {k: v for k, v in params.items() if k[0] != "_"}, depth, tf=tf))[0]
        elif stage == "lmd":
            run = settle(lmd(docs, q, params, depth))[0]
        elif stage == "rsj":
            q = settle(_expand(q, rsj_feedback(docs, run, params).withColumn("w", F.lit(float(param("rsj", "gamma", params))))))[0]
        elif stage == "kld":
            k = kld_feedback(docs, run, params)
            most = F.max("tsv").over(Window.partitionBy("topic"))
            q = settle(_expand(q, k.withColumn("w", param("kld", "gamma", params) * F.col("tsv") / most)))[0]
        elif stage == "random":
            run = q.select("topic").distinct().crossJoin(F.broadcast(random_ranking(docs, depth=depth).drop("topic")))  # depth rows
        elif stage in STAGES:
            q, run = STAGES[stage](docs, q, run, params)
        else:
            raise ValueError(f"unknown stage {stage}")
    return run


def trec_run(run: DataFrame, name: str, topics: DataFrame | None = None) -> DataFrame:
    """One line per result, "topic Q0 doc rank score name" with score = results + 1 - rank; topics without results get a FAKE row."""
    n = F.count("*").over(Window.partitionBy("topic"))
    rows = run.withColumn("fake", n + 1 - F.col("rank")).select("topic", "rank", F.concat_ws(" ", "topic", F.lit("Q0"), "doc", "rank", "fake", F.lit(name)).alias("line"))
    if topics is not None:
        rows = rows.unionByName(topics.select("topic").distinct().join(run.select("topic").distinct(), "topic", "left_anti").select("topic", F.lit(1).alias("rank"), F.concat_ws(" ", "topic", F.lit("Q0 FAKE 1 1"), F.lit(name)).alias("line")))
    return rows
