"""Loaders, recipes, featurizers and the search service."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import features, recipe
from spanloom.model import Collection
from spanloom.service import Service
from spanloom.sources import loaders


def marks(c, feature):
    return sorted((r.doc, r.content) for r in c.translate(c.term(feature)).collect())


def test_loaders(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("7\tsome words here\n8\t\nbroken\n")
    c = loaders.marco_lines(spark, f"{tmp_path}/p.tsv")
    assert [x[1].strip() for x in marks(c, ":pid")] and sorted(x[1].strip() for x in marks(c, ":pid")) == ["MARCO_7", "MARCO_8"]
    assert sorted(x[1].strip() for x in marks(c, ":paragraph")) == ["MARCO_7\nsome words here", "MARCO_8"]
    news = {"id": "n1", "title": "A title", "contents": [{"content": "First one.", "subtype": "paragraph"}, {"blurb": "aside"}, None, {"content": "Second", "subtype": "paragraph"}]}
    (tmp_path / "n.jsonl").write_text(json.dumps(news) + "\n" + json.dumps({"title": "no id"}) + "\n")
    c = loaders.news_records(spark, f"{tmp_path}/n.jsonl")
    assert [x[1].strip() for x in marks(c, ":title")] == ["A title"] and marks(c, ":author") == []
    assert [r.content.strip() for r in c.translate(c.term(":paragraph")).orderBy("p").collect()] == ["First one.", "Second"]
    assert [r.content.strip() for r in c.translate(c.term(":pid")).orderBy("p").collect()] == ["WAPO_n1-1", "WAPO_n1-3"]
    assert len(marks(c, ":article")) == 1
    (tmp_path / "v2.jsonl").write_text('{"pid": "a-1", "passage": "the text"}\n')
    assert [x[1] for x in marks(loaders.passage_records(spark, f"{tmp_path}/v2.jsonl"), ":paragraph")] == ["a-1\nthe text"]
    (tmp_path / "t.jsonl").write_text('{"id": "i", "title": "T t", "contents": "c"}\n')
    assert [x[1] for x in marks(loaders.titled_records(spark, f"{tmp_path}/t.jsonl"), ":paragraph")] == ["i\nT t\nc"]
    (tmp_path / "w.jsonl").write_text('{"text": "body words"}\n')
    with pytest.raises(Exception, match="lacks"):
        loaders.web_records(spark, f"{tmp_path}/w.jsonl").docs.collect()
    (tmp_path / "dump.json").write_text('[\n{"id": "Q1", "a": [1]},\n{"id": "Q2"}\n]\n')
    got = {(r.id, r.path) for r in loaders.object_records(spark, f"{tmp_path}/dump.json").collect()}
    assert got == {("Q1", ":"), ("Q1", ":id:"), ("Q1", ":a:"), ("Q1", ":a:[0]:"), ("Q2", ":"), ("Q2", ":id:")}
    import struct

    (tmp_path / "raw.bin").write_bytes(struct.pack("<qqqd", 5, 1, 2, 0.5) + struct.pack("<qqqd", 6, 3, 3, -1.0) + b"rest")
    assert sorted(map(tuple, loaders.raw_annotations(spark, f"{tmp_path}/raw.bin").collect())) == [(5, 1, 2, 0.5), (6, 3, 3, -1.0)]


def test_recipes():
    r = '[name:"x", recipe:[k:"v \\"q\\"", inner:[a:\'b]\']]]'
    assert recipe.cook(r) == {"name": "x", "recipe": '[k:"v \\"q\\"", inner:[a:\'b]\']]'}
    assert recipe.cook("[]") == {} and recipe.cook(' [ a : "1" , ] ') == {"a": "1"}
    assert recipe.cook(recipe.freeze({"a": '1"', "b": '[c:"d"]'}))["a"] == '1"'
    whole = recipe.freeze({"idx": recipe.freeze({"name": "simple", "recipe": '[size:"3", kind:"z"]'})})
    assert recipe.extract_option(whole, "idx:name") == "simple" and recipe.extract_option(whole, "idx:size") == "3"
    assert recipe.extract_option(recipe.interpret_option(whole, "idx:size:4"), "idx:size") == "4"
    renamed = recipe.interpret_option(whole, "idx:name:other")
    assert recipe.unwrap(recipe.cook(renamed)["idx"]) == ("other", "")
    wrapped = recipe.interpret_option(whole, "idx@cache")
    assert recipe.extract_option(wrapped, "idx:name") == "cache" and "simple" in recipe.extract_option(wrapped, "idx")
    for bad in ("", "[", "[a]", '[a:"x]', '[a:"x"] y', "[:\"x\"]"):
        with pytest.raises(recipe.RecipeError):
            recipe.cook(bad)
    for bad in ("nothing:x:y", "idx:none:4", "a:b:c:d", "nothing@x"):
        with pytest.raises(recipe.RecipeError):
            recipe.interpret_option(whole, bad)


def test_featurizers(spark):
    keys = ["a", "abcdefg", "abcdefgh", "a longer key", "#123", "é"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", features.hashed(F.col("k")).alias("f")).withColumn("back", features.unhashed(F.col("f"))).collect()
    by = {r.k: r for r in got}
    assert by["a"].f == 97 and by["#123"].f == 123 and by["abcdefg"].f < 1 << 56 <= by["abcdefgh"].f and len({r.f for r in got}) == len(keys)
    assert by["abcdefg"].back == "abcdefg" and by["é"].back == "é" and by["a longer key"].back.startswith("#")
    one = spark.createDataFrame([("x",), ("\ufdd0",)], "k string").select(features.FEATURIZERS["tagging"]("t")(F.col("k")).alias("t"), features.FEATURIZERS["json"](F.col("k")).alias("j")).collect()
    assert one[0].t == "t:x" and [r.j for r in one] == ["x", None]


def test_service(spark):
    one = Collection(spark.createDataFrame([(1, "with a from b " + "z " * 300 + "with c from"), (2, "nothing")], "doc long, text string"))
    two = Collection(spark.createDataFrame([(1, "from with"), (5, "with x x x x from")], "doc long, text string"))
    s = Service({"one": one, "two": two}, window=4)
    answers = s.answer({"op": "query", "query": "(^ with from)", "gcl": True, "size": 2})
    assert answers[0]["ok"] and [(x["collection"], x["doc"], x["rank"]) for x in answers[1:]] == [("one", 1, 1), ("two", 1, 2)]
    assert answers[1]["snippet"] == "<cover>with a from </cover>b z " or "<cover>" in answers[1]["snippet"]
    qid = answers[0]["qid"]
    assert [(x["collection"], x["doc"]) for x in s.answer({"op": "next", "qid": qid, "size": 5})] == [("two", 5)] and s.answer({"op": "next", "qid": qid}) == []
    assert s.answer({"op": "document", "collection": "one", "doc": 2}) == [{"op": "document", "ok": True, "doc": 2, "text": "nothing"}]
    assert not s.answer({"op": "document", "collection": "one", "doc": 9})[0]["ok"] and not s.answer({"op": "other"})[0]["ok"] and not s.answer({"op": "next", "qid": "x"})[0]["ok"]
    tiers = s.answer({"op": "query", "query": "with from"})
    assert tiers[0]["ok"] and tiers[1]["rank"] == 1


def test_scribes(spark, tmp_path):
    from spanloom.sources import scribe
    from spanloom.streaming.store import Store

    (tmp_path / "a.txt").write_text("some words")
    (tmp_path / "b.jsonl").write_text('{"k": "two words", "n": [3, null]}\n{"k": "other"}\n{bad\n')
    for s in (scribe.StoreScribe(Store(spark, f"file://{tmp_path}/store")), scribe.BuilderScribe(f"file://{tmp_path}/built")):
        scribe.scribe_files(spark, [f"{tmp_path}/a.txt"], s)
        scribe.scribe_json_lines(spark, [f"{tmp_path}/b.jsonl"], s)
        c = s.finalize()
        assert [x[1] for x in marks(c, "content:")] == ["some words"] and sorted(x[1].strip() for x in marks(c, ":k:")) == ["other", "two words"]
        assert [x[1].strip() for x in marks(c, ":n:[0]:")] == ["3"] and len(marks(c, ":")) == 2
        source = c.annotations.where(F.col("feature").endswith("b.jsonl")).select("feature").first().feature
        assert c.gcl(f"(<< :k: {source})").count() == 2 and s.calls == 2
    nothing = scribe.scribe_files(spark, [f"{tmp_path}/a.txt"], scribe.Scribe())
    assert nothing.finalize() is None and nothing.calls == 1
