from spanloom.functions import text as T
from spanloom.sources import jsonpaths as J
from spanloom.sources import readers
from pyspark.sql import functions as F


def test_flatten(spark):
    rows = [(1, '{"a": {"b": [1, "x", null, true, {"c": 0.5}]}, "e": {}, "f": []}'), (2, "{bad"), (3, None), (4, '"top"')]
    got = {(r.id, r.path): (r.kind, r.value, r.num, r.ok) for r in J.flatten(spark.createDataFrame(rows, "id long, js string"), "id", "js").collect()}
    assert got[(1, ":a:b:")] == ("array", None, 5.0, True) and got[(1, ":a:b:[0]:")][:3] == ("number", "1", 1.0)
    assert got[(1, ":a:b:[1]:")][:2] == ("string", "x") and got[(1, ":a:b:[2]:")][0] == "null" and got[(1, ":a:b:[3]:")][:3] == ("boolean", "true", 1.0)
    assert got[(1, ":a:b:[4]:c:")][2] == 0.5 and got[(1, ":e:")][0] == "object" and got[(1, ":f:")][2] == 0.0
    assert got[(2, ":")][3] is False and (3, ":") not in got and got[(4, ":")][:2] == ("string", "top")


def test_json_text(spark):
    df = spark.createDataFrame([('a"b\\c\nd\te', '{"k": [1, "x"]}')], "s string, js string")
    r = df.select(J.encode(F.col("s")).alias("e"), J.unmark(J.mark(F.col("js"))).alias("js"), J.at(F.col("js"), ":k:[1]:").alias("x")).first()
    assert r.e == '"a\\"b\\\\c\\nd\\te"' and r.js == '{"k": [1, "x"]}' and r.x == "x"


def test_deep_json(spark):
    deep = "1"
    for k in range(20):
        deep = f'{{"k{k}": [{deep}]}}' if k % 2 else f"[{deep}, {k}]"
    got = J.flatten(spark.createDataFrame([(1, deep), (2, "[]")], "id long, js string"), "id", "js").collect()
    assert max(r.path.count(":") for r in got) == 31 and sum(r.kind == "number" for r in got) == 11
    assert {r.path for r in got if r.id == 2} == {":"} and all(r.ok for r in got)
    shallow = J.flatten(spark.createDataFrame([(1, deep), (2, "[]")], "id long, js string"), "id", "js", depth=40).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, shallow), key=str)


def test_json_escapes_and_markers(spark):
    s = "a\x01b\x1f\"q\\\u2028"
    js = '{"k": "x:y,[z]\\\"", "n": [1, {}]}'
    r = spark.createDataFrame([(s, js)], "s string, js string").select(J.encode(F.col("s")).alias("e"), J.mark(F.col("js")).alias("m")).first()
    import json

    assert json.loads(r.e) == s
    m = {c: J.MARKERS[c] for c in J.MARKERS}
    assert r.m == f"{m['{']}{m['\"']}k{m['\"']}{m[':']} {m['\"']}x:y,[z]\\\"{m['\"']}{m[',']} {m['\"']}n{m['\"']}{m[':']} {m['[']}1{m[',']} {m['{']}{m['}']}{m[']']}{m['}']}"


def test_dates(spark):
    said = ["2009-04-01T00:00:00.000-0700", "Feb 20 2015", "Feb  3 2015", "1180075887000", "Fri May 25 19:30:28 UTC 2007", "2012-11-20T20:02:24.386Z", "never", "1969-12-31", "2015-02-31", "Foo 20 2015", None]
    got = [str(r.d) for r in spark.createDataFrame(list(enumerate(said)), "i int, s string").select("i", T.textual_date(F.col("s")).alias("d")).orderBy("i").collect()]
    assert got == ["2009-04-01", "2015-02-20", "2015-02-03", "2007-05-25", "2007-05-25", "2012-11-20"] + ["None"] * 5


def test_strings(spark):
    one = lambda s, f: spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("x")).first().x
    assert one(' <DOCNO> "hello" </DOCNO> ', T.docno) == "hello"
    assert one("a\r\nb\rc\nd", T.split_lines) == ["a", "b", "c", "d"]
    assert one(" a  b ", lambda s: T.split_tsv(s, "")) == ["a", "b"]
    assert one("one, two three", lambda s: T.skip_words(s, 1)) == "two three" and one("one", lambda s: T.skip_words(s, 1)) == ""
    assert one("The <B>US</B> iPhone &amp; x", T.xml_split) == ["the", "<B>", "US", "</B>", "iPhone", "x"]
    assert one("日本 Ünï☃code", T.utf8_split) == ["日", "本", "ünï", "☃", "code"]
    assert one("x", T.normal_path) == "./x" and one("a/x", T.normal_path) == "a/x" and one("yes", T.okay)


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Animal\tColor\nPig\tPink\nOwl\tBrown\n")
    rows = readers.tsv_files(spark, f"{tmp_path}/a.tsv", header=True)
    assert sorted((r.is_header, r.fields) for r in rows.collect()) == [(False, ["Owl", "Brown"]), (False, ["Pig", "Pink"]), (True, ["Animal", "Color"])]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"b": [2]}\n')
    assert {r.path for r in readers.json_annotations(spark, f"{tmp_path}/a.jsonl").collect()} == {"/", ":", ":a:", ":b:", ":b:[0]:"}
    (tmp_path / "q").write_text("one Q0 doc-1 2\none Q0 doc-2 -1\nbroken line\n")
    assert sorted(map(tuple, readers.judgements(spark, f"{tmp_path}/q").collect())) == [("one", "doc-1", 2), ("one", "doc-2", 0)]
    (tmp_path / "t").write_text("7\tsome words\n8 other words\n")
    assert sorted(map(tuple, readers.topics(spark, f"{tmp_path}/t").collect())) == [("7", "some words"), ("8", "other words")]
    (tmp_path / "m").write_text("c1: d1, d2\n")
    assert sorted(map(tuple, readers.duplicate_map(spark, f"{tmp_path}/m").collect())) == [("c1", "d1"), ("c1", "d2")]
    assert readers.text_files(spark, f"{tmp_path}/m").first().text == "c1: d1, d2\n"
    run = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a")], "topic string, rank int, line string")
    readers.write_run(run, f"{tmp_path}/run")
    assert [r.value for r in spark.read.text(f"{tmp_path}/run").collect()] == ["a", "b"]
