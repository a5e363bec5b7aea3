"""Ranking, feedback and answers against plain Python over a small collection."""

import math
import random
from collections import Counter

import pytest

from spanloom.model import Collection
from spanloom.operators import evaluate as E
from spanloom.operators import rank as R
from spanloom.operators import stats as S


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["with", "from", "this"] + [f"w{i}" for i in range(40)]
    return [" ".join(rng.choice(words[: rng.choice([6, 43])]) for _ in range(rng.randint(3, 120))) for _ in range(60)]


@pytest.fixture(scope="module")
def collection(spark, texts):
    return Collection.of(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").annotate(spark.createDataFrame([], "feature string, doc long, p long, q long, v double, n long"))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return Collection.of(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")


def queries(spark, *terms):
    return spark.createDataFrame([(1, t, 1.0) for t in terms], "topic long, term string, w double")


def test_bm25_and_lmd(spark, docs, texts):
    split = [t.split() for t in texts]
    n, avgl = len(split), sum(map(len, split)) / len(split)
    df = Counter(w for s in split for w in set(s))
    ctf = Counter(w for s in split for w in s)
    rsj = lambda t: max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
    terms = ["w7", "w9", "with"]
    want = {d: sum(rsj(t) * s.count(t) / (0.5 * (0.75 + 0.25 * len(s) / avgl) + s.count(t)) for t in terms) for d, s in enumerate(split)}
    got = {r.doc: r.score for r in R.bm25(docs.docs, queries(spark, *terms)).collect()}
    assert set(got) == {d for d, x in want.items() if x > 0} and all(abs(got[d] - want[d]) < 1e-5 for d in got)
    lm = {r.doc: r.score for r in R.lmd(docs.docs, queries(spark, *terms)).collect()}
    for d, s in enumerate(split):
        if any(t in s for t in terms):
            assert abs(lm[d] - sum(math.log(2000 + s.count(t) * sum(map(len, split)) / ctf[t]) - math.log(2000 + len(s)) for t in terms if t in s)) < 1e-5


def test_scores_are_summed_where_a_document_is(spark, docs):
    """Matches are shuffled by document once; a sum for each topic and document that is shuffled again grows with topics times documents."""
    import re

    q = queries(spark, "w7", "w9")
    for run in (R.bm25(docs.docs, q), R.lmd(docs.docs, q), R.bm25_trials(docs.docs, q, R.random_params("bm25", 3))):
        plan = run._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(doc#\d+L, \d+\), REPARTITION", plan) and not re.search(r"hashpartitioning\((trial#\d+, )?topic#\d+L, doc", plan)


def test_golden_statistics(spark):
    rows = [(0, "hello world hello hello"), (1, "hello world hello there"), (2, "the quick cat in the hat"), (3, "hello to you")]
    d = Collection.of(spark.createDataFrame(rows, "id long, text string"), "id", "text").docs
    df = {r.term: r.df for r in S.df(d).collect()}
    assert df["hello"] == 3 and df["world"] == 2 and df["quick"] == 1
    w = {r.term: (r.idf, r.rsj) for r in S.df(d).select("term", S.idf(4, S.F.col("df")).alias("idf"), S.rsj(4, S.F.col("df")).alias("rsj")).collect()}
    assert abs(w["hello"][0] - 0.287682) < 1e-6 and abs(w["world"][0] - 0.693147) < 1e-6 and abs(w["quick"][1] - 0.847298) < 1e-6 and w["hello"][1] == 0


def _counts(texts):
    count = Counter(w for t in texts for w in t.split())
    return count, sum(count.values()) + len(count)


def test_qa_feedback(docs, texts):
    run = R.ssr(docs, "(^ with from)")
    rows = [r for r in run.collect() if r["rank"] <= 16]
    count, total = _counts(texts)
    f, e = Counter(), Counter()
    for r in rows:
        best = {}
        for at, w in enumerate(texts[r.doc].split()):
            if r.p - 64 <= at <= r.q + 64:
                gap = r.q - at if at < r.p else at - r.p - 1 if at > r.q else r.q - r.p + 1
                best[w] = min(gap, best.get(w, gap))
        for w, gap in best.items():
            f[w] += 1
            e[w] += 1 - (1 - (count[w] + 1) / total) ** max(gap, 1)
    want = sorted(((round(f[w] * math.log(f[w] / e[w]), 5), w) for w in f if f[w] > 1), key=lambda x: (-x[0], x[1]))[:8]
    got = [(round(r.tsv, 5), r.term) for r in R.qa_feedback(docs, run).orderBy("rank").collect()]
    assert [x[0] for x in got] == pytest.approx([x[0] for x in want], abs=1e-4)


def test_answers(docs, texts):
    weights = {"with": 2.0, "from": 2.5, "this": 3.0}
    terms = list(weights)
    covers = R.icover(docs, terms, weights, 32).collect()
    count, total = _counts(texts)
    weight, passages = Counter(), []
    for r in covers:
        w = texts[r.doc].split()
        lo, hi = max(0, r.p - 64), min(len(w) - 1, r.q + 64)
        best = {}
        for at in range(lo, hi + 1):
            gap = max(r.p - at, at - r.q, 0)
            best[w[at]] = min(gap, best.get(w[at], gap))
        for x, gap in best.items():
            weight[x] += math.log(total / ((count[x] + 1) * (gap + 1)))
        passages.append((r.doc, w[lo : hi + 1]))
    value = {x: v**3 for x, v in weight.items() if x not in terms}
    best = {}
    for doc, w in passages:
        for s in range(max(len(w) - 64, 0) + 1):
            score = sum(value.get(x, 0) for x in set(w[s : s + 64]))
            if doc not in best or score > best[doc] + 1e-6:
                best[doc] = score
    want = sorted(best.values(), reverse=True)[:5]
    got = R.qap(docs, terms, weights).orderBy("rank").collect()
    assert [r.score for r in got] == pytest.approx(want, rel=1e-6)
    assert all(len(r.snippet.split()) <= 64 for r in got)


def test_tiers(docs, texts):
    tiers = R.build_tiers(docs, "with from this")
    assert tiers[0].startswith(("(^", "(+ (^")) and len(tiers) >= 1
    got = R.tiered(docs, tiers).collect()
    holds = [len({"with", "from", "this"} & set(t.split())) for t in texts]
    assert {r.doc for r in got} >= {d for d, n in enumerate(holds) if n == 3}
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_annotations_do_not_change_terms(collection, docs):
    for q in ("(^ with from)", '"with from"', "(2 with from this)"):
        assert sorted(map(tuple, collection.gcl(q).collect())) == sorted(map(tuple, docs.gcl(q).collect()))


def test_metrics(spark):
    run = spark.createDataFrame([("a", d, r, 10) for r, d in enumerate([5, 3, 9, 1], 1)], "topic string, doc long, rank int, len int")
    qrels = E.gains(spark.createDataFrame([("a", 3, 1), ("a", 1, 1), ("a", 7, 1), ("a", 5, 0)], "topic string, doc long, grade int")).select("topic", "doc", "gain")
    p = E.precision(run, qrels).first()
    assert (p.rr, p.ret, p.rel, p.rel_ret) == (0.5, 4, 3, 2) and p.ap == pytest.approx((1 / 2 + 2 / 4) / 3) and p.p05 == 0.4
    n = E.ndcg(run, qrels).first()
    dcg = lambda ranks: sum(0.5 * math.log(2) / math.log(r + 1) for r in ranks)
    assert n.dcg == pytest.approx(dcg([2, 4])) and n.ndcg == pytest.approx(dcg([2, 4]) / dcg([1, 2, 3]))
    b = E.rbp(run, qrels).first()
    assert b.rbp50 == pytest.approx(0.5 * 0.5 * (0.5 + 0.125))
    m = E.med(run, run).first()
    assert (m.med_dcg, m.med_rbp50) == (0, 0)
    t = E.tbg(run, qrels).first().tbg
    step = lambda c: 4.4 + (0.18 + 7.8) * c
    spent = step(0.39)
    want = 0.64 * 0.77 * math.exp(-spent * math.log(2) / 224)
    spent += step(0.64) + step(0.39)
    assert t == pytest.approx(want + 0.64 * 0.77 * math.exp(-spent * math.log(2) / 224))


def test_random_parameters():
    a = R.random_params("bm25", 50, 3)
    assert a == R.random_params("bm25", 50, 3) and a[0] == R.DEFAULTS["bm25"]
    assert all(0 <= p["b"] <= 1 and 0.01 <= p["k1"] <= 1000 for p in a)
    assert R.param("bm25", "b", {"b": 1.0, "bm25:b": 2.0}) == 2.0 and R.param("ssr", "K", {}) == 42.0
