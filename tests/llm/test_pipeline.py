"""The pipeline against the same decisions made one document at a time."""

import corpus_pipeline as P
import numpy as np
from samples import SCHEMA
from test_operators import toxic_corpus

from spanloom.llm import secrets, simhash, token_ids, toxicity


def test_pipeline(spark, tmp_path):
    rows, labels = toxic_corpus(spark, 200)
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[1][1].replace(" ", "\n"), "en", "s", 0), (1002, rows[2][1] + " extra", "en", "s", 0), (1003, "token = abcdefgh12345678 and more", "en", "s", 0), (1004, None, None, None, None), (None, "nobody's text", "en", "s", 13)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    model = toxicity.fit_toxicity(docs, labels)
    scores = toxicity.Scorer(model.odds, model.prior).scores([t or "" for _, t, *_ in rows])
    left = [(i, t or "") for (i, t, *_), s in zip(rows, scores) if s < toxicity.THRESHOLD]
    best = {}
    for i, t in left:
        rank = (-len(t), i is None, i or 0)
        body = "".join(t.split())
        best[body] = min(best.get(body, rank), rank)
    left = [(i, t) for i, t in left if (-len(t), i is None, i or 0) == best["".join(t.split())]]
    code = {r.doc_id: np.array([r.f0, r.f1, r.f2, r.f3], np.int64).view(np.uint64) for r in simhash.simhash(docs).collect()}
    order = sorted(left, key=lambda x: (x[0] is None, x[0] or 0))
    kept = []
    for i, t in order:
        if not any(np.bitwise_count(code[i] ^ code[j]).sum() <= simhash.MAX_DISTANCE for j, _ in kept):
            kept.append((i, t))
    enc = token_ids.encoder(token_ids.default_path())
    want = {i: [*enc.encode(secrets.redact(t, secrets.all_spans(t)[1])).tolist(), 1] for i, t in kept}
    found = {}
    for r in sorted(got, key=lambda r: r.start):
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == want
    assert 1000 not in found and 1001 not in found and 1002 not in found and 1003 in found


def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    """Null ids, repeated ids and repeated rows beside columns with clashing names."""
    rows = [(1, "alpha x", "k"), (None, "alpha x", "k"), (None, "beta y", "k"), (4, "B text", "k"), (5, "A text", "k"), (5, "B text", "k"), (5, "A text", "k"), (6, None, "k"), (7, " ", "k"), (8, "C  text", "k"), (8, "C text", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").selectExpr("*", "1 AS k1", "2 AS row", "3 AS text_key", "4 AS kept", "5 AS `a.b`")
    got = P.exact(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "beta y"), (1, "alpha x"), (4, "B text"), (5, "A text"), (7, " "), (8, "C  text")]
    assert all(r._text == "k" and r["a.b"] == 5 for r in got.collect())
    near = P.near(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in near.collect())
    assert len(kept) == len(set(kept)) and (0, "beta y") in kept and (1, "alpha x") in kept and (0, "alpha x") not in kept and kept.count((5, "A text")) == 1


def test_stages_keep_columns(spark, tmp_path):
    rows, labels = toxic_corpus(spark, 40)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.schema.names
        assert not stage(spark, docs.limit(0), str(tmp_path)).collect()
