"""Window sweeps against the set definitions, on random lists."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.model import ANNOTATION, Collection
from spanloom.operators import intervals as I
from spanloom.plans.expr import parse


def G(s):
    s = set(s)
    return {a for a in s if not any(b != a and b[0] >= a[0] and b[1] <= a[1] for b in s)}


def random_list(rng):
    return G({(p, p + rng.randint(0, 4)) for p in (rng.randint(0, 30) for _ in range(rng.randint(0, 9)))})


DOCS = 60
NAMES = "abcd"


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(2)
    return {n: [random_list(rng) for _ in range(DOCS)] for n in NAMES}


@pytest.fixture(scope="module")
def collection(spark, lists):
    rows = [(n + ":", d, p, q, float(p), p + 100) for n in NAMES for d, s in enumerate(lists[n]) for p, q in s]
    texts = spark.createDataFrame([(d, " ".join(["x"] * 40)) for d in range(DOCS)], "doc long, text string")
    return Collection(texts).annotate(spark.createDataFrame(rows, ANNOTATION))


def brute(e, lists, d):
    k = e.kind
    if k == "term":
        return lists[e.term[0]][d]
    if k == "fixed":
        return {(p, p + e.n - 1) for p in range(0, 41 - e.n)}
    args = [brute(a, lists, d) for a in e.args]
    if k == "or":
        return G(set().union(*args))
    if k in ("and", "of"):
        n = e.n if k == "of" else len(args)
        return G({(min(p for p, _ in c), max(q for _, q in c)) for own in itertools.combinations(args, n) for c in itertools.product(*own)})
    if k == "seq":
        out = args[0]
        for b in args[1:]:
            out = G({(x[0], y[1]) for x in out for y in b if x[1] < y[0]})
        return out
    out = args[0]
    for b in args[1:]:
        inside = lambda x, b=b: any(y[0] <= x[0] and x[1] <= y[1] for y in b)
        holds = lambda x, b=b: any(x[0] <= y[0] and y[1] <= x[1] for y in b)
        out = {x for x in out if {"in": inside, "has": holds, "not_in": lambda x: not inside(x), "not_has": lambda x: not holds(x)}[k](x)}
    return out


QUERIES = [
    "(+ a: b:)", "(^ a: b:)", "(^ a: b: c:)", "(... a: b:)", "(... a: b: c:)", "(<< a: b:)", "(>> a: b:)", "(!< a: b:)", "(!> a: b:)", "(<< a: b: c:)", "(2 a: b: c:)", "(2 a: b: c: d:)", "(3 a: b: c: d:)", "(+ (^ a: b:) (... c: d:))", "(>> (^ a: b:) (... c: d:))",
    "(!> (... a: b:) c:)", "(<< (^ a: b:) (# 6))", "(!< a: (# 2))", "(>> a: (# 3))", "(!> a: (# 3))", "(>> (# 6) (^ a: b:))", "(<< (# 3) (^ a: b:))", "(>> (<< (^ a: b:) (... a: b:)) (... a: b:))", "(^ a: a:)", "(+ a:)", "(^ a: (# 3))",
]


@pytest.mark.parametrize("query", QUERIES)
def test_operators(collection, lists, query):
    e = parse(query)
    got = {}
    for r in collection.gcl(e).collect():
        got.setdefault(r.doc, []).append((r.p, r.q))
    for d in range(DOCS):
        assert sorted(got.get(d, [])) == sorted(brute(e, lists, d)), d


def test_values(collection):
    kept = collection.gcl("(<< a: (+ b: c: a:))").collect()
    assert kept and all(r.v == r.p and r.n == r.p + 100 for r in kept)
    assert all(r.v == 0 and r.n is None for r in collection.gcl("(^ a: b:)").collect())
    assert {r.p for r in collection.gcl("(@ a:)").where("doc = 0").collect()} == {r.n for r in collection.gcl("a:").where("doc = 0").collect()}


def test_complement(collection):
    rows = lambda q: sorted(map(tuple, collection.gcl(q).select("doc", "p", "q").collect()))
    assert sorted(rows("(<< a: b:)") + rows("(!< a: b:)")) == rows("a:") == sorted(rows("(>> a: b:)") + rows("(!> a: b:)"))


def test_merge_keeps_the_last_value(spark):
    one = spark.createDataFrame([(0, 1, 5, 1.0, 1), (0, 3, 4, 1.0, 1)], "doc long, p long, q long, v double, n long")
    two = spark.createDataFrame([(0, 3, 4, 2.0, 2), (0, 7, 9, 2.0, 2)], "doc long, p long, q long, v double, n long")
    assert sorted((r.p, r.q, r.n) for r in I.merge([one, two]).collect()) == [(3, 4, 2), (7, 9, 2)]
    assert sorted((r.p, r.q, r.n) for r in I.merge([one, two], last_wins=False).collect()) == [(3, 4, 1), (7, 9, 2)]


@pytest.mark.parametrize("n", ["1", "7"])
def test_partitions_do_not_matter(spark, collection, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rows = lambda: sorted(map(tuple, collection.gcl("(>> (^ a: b:) (+ c: d:))").collect()))
    want = rows()
    spark.conf.set("spark.sql.shuffle.partitions", n)
    assert rows() == want
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_text_collection(spark):
    text = "Title one\nHello US world. hello World\nHELLO iPhone hello\n"
    c = Collection.of(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text")
    at = lambda q: sorted((r.p, r.q) for r in c.gcl(q).collect())
    assert at("hello") == [(2, 2), (5, 5), (7, 7), (9, 9)] and at("HELLO") == [(7, 7)] and at("US") == [(3, 3)] and at("us") == [(3, 3)]
    assert at("(... hello world)") == [(2, 4), (5, 6)]
    assert at('"hello world"') == [(5, 6)] and at('"US world"') == [(3, 4)]
    lines = c.annotate(c.lines())
    assert sorted((r.p, r.q, r.n) for r in lines.gcl("(>> line: world)").collect()) == [(2, 6, 2)]
    assert [r.content for r in c.translate(c.gcl("(... hello world)")).orderBy("p").collect()] == ["Hello US world. ", "hello World\n"]


def test_optimized_queries_agree(collection):
    from spanloom.plans.expr import optimize

    e = parse("(<< (^ a: b: c:) d:)")
    rows = lambda x: sorted(map(tuple, collection.gcl(x).select("doc", "p", "q").collect()))
    assert rows(optimize(e, {"a:": 3, "b:": 1, "c:": 2}.get)) == rows(e)


def test_icover(spark):
    from spanloom.operators import rank as R

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "c", "x", "y", "z"]) for _ in range(rng.randint(1, 25))) for _ in range(80)]
    c = Collection.of(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    weights = {"a": 1.5, "b": 2.5, "c": 4.0}
    got = {r.doc: r.score for r in R.icover(c, list(weights), weights).collect()}
    import math

    for d, t in enumerate(texts):
        at = {w: [i for i, x in enumerate(t.split()) if x == w] for w in weights}
        best = 0.0
        for n in (1, 2, 3):
            for own in itertools.combinations(weights, n):
                for places in itertools.product(*(at[w] for w in own)):
                    best = max(best, sum(weights[w] for w in own) - n * math.log(max(places) - min(places) + 1))
        assert abs(got.get(d, 0.0) - best) < 1e-5, t
    assert F is not None
