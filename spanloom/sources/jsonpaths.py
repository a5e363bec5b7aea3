"""JSON documents as (path, value) annotations, by way of Spark's variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared

#: Characters that stand for JSON structure in token streams; in data they are replaced.
MARKERS = {c: chr(0xFDD0 + i) for i, c in enumerate('{}[]":,')}
STRUCTURE = "[\uFDD0-\uFDD6]"
_NON = "[\uFDD0-\uFDEF]"
#: Levels of nesting that flatten() looks into in one pass; deeper documents take a pass for as many levels.
DEPTH = 4


def sanitize(s: Column) -> Column:
    return F.regexp_replace(s, _NON, "\uFFFD")


def flatten(docs: DataFrame, id_col: str, json_col: str, depth: int = DEPTH) -> DataFrame:
    """(id, path, kind, value, num, ok): a row for every value of every document.

    Paths are :a:b: and :a:[0]:, the whole document is ":".  value is the text of
    a scalar, num its number (1 and 0 for booleans, the length of an array).
    Malformed documents give one row with ok = false.  A document of at most
    `depth` opening brackets isn't nested deeper than that: such documents are one
    plan without a job of its own, in which each value is kept and, if it is a
    container, taken apart beside it.  Of others, if there are any, what lies below
    `depth` levels is written to the shared folder and treated in the same way.
    """
    base = docs.select(F.col(id_col).alias("id"), F.try_parse_json(sanitize(F.col(json_col))).alias("v"), F.col(json_col).isNotNull().alias("given"), F.regexp_count(F.col(json_col), F.lit(r"[{\[]")).alias("open"))
    out = base.where("v is null and given").select("id", F.lit(":").alias("path"), F.lit("error").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("num"), F.lit(False).alias("ok"))
    level = base.where("v is not null").select("id", F.lit(":").alias("path"), "v", "open")
    out = out.unionByName(_describe(_levels(level.where(F.col("open") <= depth), depth)))
    deep = docs.where(F.regexp_count(F.col(json_col), F.lit(r"[{\[]")) > depth)
    if not deep.limit(1).count():
        return out
    level = level.where(F.col("open") > depth)
    while True:
        every = _levels(level, depth)
        out = out.unionByName(_describe(every.where(F.col("level") < depth)))
        rest = every.where(F.col("level") == depth).select("id", "path", "v")
        if not rest.limit(1).count():
            return out
        level = shared.materialize(rest.select("id", "path", F.to_json("v").alias("js")), "json").select("id", "path", F.parse_json("js").alias("v"))


def _levels(rows: DataFrame, depth: int) -> DataFrame:
    rows = rows.select("id", "path", "v", F.lit(0).alias("level"))
    for k in range(depth):
        rows = _deeper(rows, k)
    return rows


def _deeper(rows: DataFrame, k: int) -> DataFrame:
    """rows, with what the containers of level k hold as rows of level k + 1 beside them."""
    open_ = (F.col("level") == k) & _kind(F.col("v")).isin("object", "array")
    names = F.when(open_ & (_kind(F.col("v")) == "object"), F.try_variant_get("v", "$", "map<string,variant>"))
    places = F.when(open_ & (_kind(F.col("v")) == "array"), F.try_variant_get("v", "$", "array<variant>"))
    own = F.struct(F.col("path").alias("path"), F.col("v").alias("v"), F.col("level").alias("level"))
    inner = lambda step, v: F.struct(F.concat("path", step, F.lit(":")).alias("path"), v.alias("v"), F.lit(k + 1).alias("level"))
    fields = F.transform(F.map_entries(names), lambda x: inner(x["key"], x["value"]))
    items = F.transform(places, lambda x, i: inner(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))
    none = F.array().cast("array<struct<path:string,v:variant,level:int>>")
    return rows.select("id", F.explode(F.concat(F.array(own), F.coalesce(fields, none), F.coalesce(items, none))).alias("x")).select("id", "x.path", "x.v", "x.level")


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s.isin("VOID"), "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").otherwise("number")
    )


def _describe(level: DataFrame) -> DataFrame:
    kind = _kind(F.col("v"))
    text = F.when(kind == "null", "null").when(~kind.isin("object", "array"), F.try_variant_get("v", "$", "string"))
    number = F.when(kind == "number", F.try_variant_get("v", "$", "double")).when(kind == "boolean", F.try_variant_get("v", "$", "boolean").cast("int").cast("double"))
    number = number.when(kind == "array", F.size(F.try_variant_get("v", "$", "array<variant>")).cast("double"))
    return level.select("id", "path", kind.alias("kind"), text.alias("value"), number.alias("num"), F.lit(True).alias("ok"))


def at(json: Column, path: str) -> Column:
    """The text at :a:b: or :a:[0]: of a JSON string."""
    steps = [s for s in path.split(":") if s]
    return F.get_json_object(json, "$" + "".join(s if s[0] == "[" else f".{s}" for s in steps))


def encode(s: Column) -> Column:
    """A JSON string literal of s, quotes, backslashes and control characters escaped as JSON wants them."""
    x = F.regexp_replace(sanitize(s), r"\\", r"\\\\")
    x = F.regexp_replace(x, '"', r'\\"')
    for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        x = F.replace(x, F.lit(raw), F.lit("\\" + name))
    rest = x
    for code in (c for c in range(32) if c not in (8, 9, 10, 12, 13)):
        rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    x = F.when(x.rlike(r"[\x00-\x1F]"), rest).otherwise(x)
    return F.concat(F.lit('"'), x, F.lit('"'))


def mark(s: Column) -> Column:
    """JSON text with its structural characters as markers; characters inside strings stay as they are."""
    strings = F.regexp_extract_all(sanitize(s), F.lit(_STRING), F.lit(0))
    between = F.split(sanitize(s), _STRING, -1)
    outside = F.transform(between, lambda x: F.translate(x, "".join(MARKERS), "".join(MARKERS.values())))
    inside = F.transform(strings, lambda x: F.concat(F.lit(MARKERS['"']), F.substring(x, F.lit(2), F.length(x) - 2), F.lit(MARKERS['"'])))
    return F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def unmark(s: Column) -> Column:
    """Markers back to the JSON characters they stand for."""
    return F.translate(s, "".join(MARKERS.values()), "".join(MARKERS))


_STRING = r'"(?:[^"\\]|\\.)*+"'
