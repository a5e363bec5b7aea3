"""Stored postings and statistics against what the texts give, and how little of them a query reads."""

import random

import pytest

from spanloom.model import ANNOTATION, Collection
from spanloom.operators import rank as R
from spanloom.operators import stats as S
from spanloom.streaming.store import tf_idf_forager


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    words = ["with", "from", "this", "iPhone", "iphone", "USA", *(f"w{i}" for i in range(50))]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([7, 56])]) for _ in range(rng.randint(0, 80)))) for i in range(80)]
    return Collection.of(spark.createDataFrame(rows, "id long, text string"), "id", "text")


@pytest.fixture(scope="module")
def indexed(docs, tmp_path_factory):
    return docs.indexed(f"file://{tmp_path_factory.mktemp('index')}/i")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_index_agrees_with_texts(spark, docs, indexed):
    own, text = indexed.index, S.Stats(docs.docs)
    assert rows(own.tf().select("doc", "len", "term", "tf")) == rows(text.tf().select("doc", "len", "term", "tf"))
    assert rows(own.counts()) == rows(text.counts()) and rows(own.totals()) == rows(text.totals()) and rows(own.vocabulary()) == rows(text.vocabulary())
    assert rows(indexed.lengths()) == rows(docs.lengths())
    terms = spark.createDataFrame([("with",), ("iPhone",), ("iphone",), ("none",)], "term string")
    assert rows(own.df(terms)) == rows(text.df(terms))
    assert rows(own.weights(own.tf(terms), terms).select("term", "df", "ctf")) == rows(text.weights(text.tf(terms)).select("term", "df", "ctf"))
    for q in ("with", "iPhone", "iphone", "(^ with from)", '"with from"', "(2 with from this)", "(# 3)", "(<< (# 4) (... with from))"):
        assert rows(indexed.gcl(q)) == rows(docs.gcl(q)), q
    assert indexed.count_of(["with", "USA", "usa", "none"]) == docs.count_of(["with", "USA", "usa", "none"])


def test_a_larger_collection_is_written_in_more_parts(docs, tmp_path, monkeypatch):
    """What one task sorts and writes doesn't grow with the collection."""
    from spanloom.operators import index as X

    monkeypatch.setattr(X, "WORDS_A_PART", 500)
    monkeypatch.setattr(X, "ROWS_A_BATCH", 100)
    c = docs.indexed(f"file://{tmp_path}/i")
    files = [f.split("/")[-2] for f in c.index.rows(["with"]).inputFiles()]
    assert len(files) > 2 and len(set(files)) == 1
    assert rows(c.index.tf()) == rows(S.Stats(docs.docs).tf().select("doc", "len", "term", "tf"))
    assert rows(c.gcl('"with from"')) == rows(docs.gcl('"with from"')) and rows(c.index.counts()) == rows(S.Stats(docs.docs).counts())


def test_many_terms_are_joined(spark, docs, indexed, monkeypatch):
    from spanloom.operators import index as X

    monkeypatch.setattr(X, "FILTER_TERMS", 1)
    terms = spark.createDataFrame([("with",), ("USA",)], "term string")
    assert rows(indexed.index.tf(terms)) == rows(S.Stats(docs.docs).tf(terms).select("doc", "len", "term", "tf"))
    assert rows(indexed.index.df(terms)) == rows(S.Stats(docs.docs).df(terms))


def test_rankings_agree(spark, docs, indexed):
    q = spark.createDataFrame([(1, "w3", 1.0), (1, "w9", 2.0), (2, "USA", 1.0)], "topic long, term string, w double")
    for f in (R.bm25, R.lmd):
        assert rows(f(indexed.index, q)) == rows(f(docs.docs, q))
    run = R.settle(R.bm25(docs.docs, q))[0]
    assert rows(R.rsj_feedback(indexed.index, run)) == rows(R.rsj_feedback(docs.docs, run))
    assert rows(R.kld_feedback(indexed.index, run)) == rows(R.kld_feedback(docs.docs, run))
    assert rows(R.pipeline(indexed.index, q, "bm25 rsj bm25")) == rows(R.pipeline(docs.docs, q, "bm25 rsj bm25"))
    trials = [{"b": 0.25, "k1": 0.5}, {"b": 0.9, "k1": 2.0}]
    every = R.bm25_trials(indexed.index, q, trials)
    for i, p in enumerate(trials):
        assert rows(every.where(f"trial = {i}").drop("trial")) == rows(R.bm25(docs.docs, q, p))


def test_a_query_reads_its_terms_only(indexed):
    plan = indexed.index.rows(["with"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", "") and "EqualTo(feature,with)" in plan
    assert len(indexed.index.rows(["with"]).inputFiles()) >= 1


def test_an_interrupted_build_is_done_again(spark, docs, tmp_path):
    path = f"file://{tmp_path}/i"
    spark.range(3).write.parquet(f"{path}/lengths")
    spark.range(3).write.parquet(f"{path}/terms")
    c = docs.indexed(path)
    assert c.index.whole() and rows(c.index.counts()) == rows(S.Stats(docs.docs).counts())


def test_statistics_are_selected(spark, docs, indexed):
    assert S.select(docs).__class__ is S.Stats and S.select(indexed) is indexed.index and S.select(indexed, {"statistics": "text"}).__class__ is S.Stats
    foraged = docs.annotate(tf_idf_forager(docs, docs.lengths().where("length > 0").selectExpr("doc", "0L AS p", "length - 1 AS q", "0.0D AS v", "NULL AS n")))
    stats = S.select(foraged, {"statistics": "tf-idf"})
    want = {(r.doc, r.term): r.tf for r in S.Stats(docs.docs).tf().collect() if r.term == r.term.lower() and r.term != "iphone" and r.term != "usa"}
    got = {(r.doc, r.term): r.tf for r in stats.tf().collect()}
    assert all(got[k] == v for k, v in want.items())
    for bad in ("index", "nothing"):
        with pytest.raises(ValueError):
            S.select(docs, {"statistics": bad})


def test_foraging_over_overlapping_intervals(spark):
    c = Collection(spark.createDataFrame([(1, "a b a c b a"), (2, "x"), (3, "")], "doc long, text string"))
    spans = spark.createDataFrame([("s:", 1, 0, 2, 0.0, None), ("s:", 1, 1, 4, 0.0, None), ("s:", 1, 5, 5, 0.0, None)], ANNOTATION)
    got = {(r.feature, r.p): r.n for r in tf_idf_forager(c, spans).collect()}
    assert got == {("tf:a", 0): 2, ("tf:b", 0): 1, ("tf:b", 1): 2, ("tf:a", 1): 1, ("tf:c", 1): 1, ("tf:a", 5): 1, ("df:a", 0): 3, ("df:b", 0): 2, ("df:c", 0): 1}


def test_foraging_takes_as_long_as_a_text_is(spark):
    """A sweep that looks ahead over a whole text for each of its words takes the square of its length."""
    import time

    def took(n):
        c = Collection(spark.createDataFrame([(1, " ".join(f"w{i % 97}" for i in range(n)))], "doc long, text string"))
        lines = spark.createDataFrame([("s:", 1, i, i + 9, 0.0, None) for i in range(0, n, 10)], ANNOTATION)
        began = time.time()
        got = {r.feature: r.n for r in tf_idf_forager(c, lines).where("feature like 'df:%'").collect()}
        assert len(got) == 97 and sum(got.values()) == n
        return time.time() - began

    took(1000)
    assert took(60_000) < 60


def test_foraging_beyond_a_text(spark):
    c = Collection(spark.createDataFrame([(1, "a b"), (2, "")], "doc long, text string"))
    spans = spark.createDataFrame([("s:", 1, 1, 9, 0.0, None), ("s:", 1, 7, 12, 0.0, None), ("s:", 2, 0, 1, 0.0, None)], ANNOTATION)
    assert sorted((r.feature, r.doc, r.p, r.n) for r in tf_idf_forager(c, spans).collect()) == [("df:b", 1, 0, 1), ("tf:b", 1, 1, 1)]


def test_queries_are_rewritten_by_counts(docs, indexed, monkeypatch):
    from spanloom import model

    seen = []
    real = model.lower
    monkeypatch.setattr(model, "lower", lambda e, c: seen.append(str(e)) or real(e, c))
    c = indexed.annotate(indexed.lines())
    q = "(<< (^ with w3 w4) line:)"
    first = rows(c.gcl(q))
    assert seen[-1] != q and seen[-1].startswith("(<< (^ (<< (^ w")
    c.params["optimize"] = False
    assert rows(c.gcl(q)) == first and seen[-1] == q
    plain = docs.annotate(docs.lines())
    assert rows(plain.gcl(q)) == first


def test_stages_can_be_added(spark, docs):
    @R.stage("double")
    def double(source, queries, run, params):
        return queries.withColumn("w", queries.w * 2), run

    q = spark.createDataFrame([(1, "w3", 1.0)], "topic long, term string, w double")
    one, two = R.pipeline(docs.docs, q, "bm25").collect(), R.pipeline(docs.docs, q, "double bm25").collect()
    assert {r.doc: round(2 * r.score, 4) for r in one} == {r.doc: round(r.score, 4) for r in two}
    with pytest.raises(ValueError):
        R.pipeline(docs.docs, q, "nothing")
