"""Collections of known layouts: records become documents whose parts are annotated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import Collection
from . import readers

_PART = "struct<feature:string,text:string>"


def part(feature: str, text: Column) -> Column:
    """A part of a record: its text, and the feature that marks it ("" for none)."""
    return F.struct(F.lit(feature).alias("feature"), text.cast("string").alias("text")).cast(_PART)


def doc_of(docno: Column) -> Column:
    """A document's number in the address space: 62 bits of a hash of what identifies it."""
    return F.shiftrightunsigned(F.xxhash64(docno), 2)


def of_parts(rows: DataFrame, whole: list[str]) -> Collection:
    """rows: (doc, parts: array<struct<feature, text>>); whole: features that span all parts of a record.

    A part whose text is null is left out; one without tokens has no annotation,
    nor has a record without any.
    """
    rows = rows.select(F.col("doc").cast("long").alias("doc"), F.filter("parts", lambda x: x["text"].isNotNull()).alias("parts"))
    docs = rows.select("doc", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    sizes = rows.select("doc", "parts", F.transform("parts", lambda x: F.size(T.ascii_words(x["text"])).cast("long")).alias("sizes"))
    ends = F.aggregate("sizes", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x)))
    sizes = sizes.withColumn("ends", ends)
    each = sizes.select("doc", F.explode(F.arrays_zip("parts", "sizes", "ends")).alias("x")).where("x.sizes > 0 and x.parts.feature <> ''")
    none = (F.lit(0.0).alias("v"), F.lit(None).cast("long").alias("n"))
    marks = each.select(F.col("x.parts.feature").alias("feature"), "doc", (F.col("x.ends") - F.col("x.sizes")).alias("p"), (F.col("x.ends") - 1).alias("q"), *none)
    total = F.element_at("ends", -1)
    spans = sizes.where("size(ends) > 0").where(total > 0).select(F.explode(F.array(*map(F.lit, whole))).alias("feature"), "doc", F.lit(0).cast("long").alias("p"), (total - 1).alias("q"), *none)
    return Collection(docs).annotate(marks.unionByName(spans))


def file_tree(spark: SparkSession, *paths: str) -> Collection:
    """Whole files: filename:, content: and file: around both."""
    rows = readers.text_files(spark, *paths)
    return of_parts(rows.select(doc_of(F.col("source")).alias("doc"), F.array(part("filename:", F.col("source")), part("content:", F.col("text"))).alias("parts")), ["file:"])


def marco_lines(spark: SparkSession, *paths: str) -> Collection:
    """Passages as lines "number<TAB>text": :pid with a prefix, :paragraph around all."""
    f = F.split("value", "\t", 2)
    pid = F.concat(F.lit("MARCO_"), f[0])
    rows = spark.read.text(list(paths)).where(F.contains("value", F.lit("\t")))
    return of_parts(rows.select(doc_of(pid).alias("doc"), F.array(part(":pid", pid), part("", F.get(f, F.lit(1)))).alias("parts")), [":paragraph"])


def _records(spark: SparkSession, paths: tuple, ddl: str) -> DataFrame:
    return readers.json_lines(spark, *paths).select("source", F.from_json("json", ddl).alias("r")).select("source", "r.*")


def web_docs(records: DataFrame) -> DataFrame:
    """records (text, url, ...) with `doc`: several of the same url are documents of their own, as are equal ones, which are numbered."""
    k = F.row_number().over(Window.partitionBy("url", "text").orderBy(F.lit(0)))
    return records.withColumn("k", k).withColumn("doc", doc_of(F.struct("url", "text", "k"))).drop("k")


def web_records(spark: SparkSession, *paths: str) -> Collection:
    """JSON lines of text and url: :text, :url and : around both; a record without either is an error."""
    r = web_docs(_records(spark, paths, "text string, url string"))
    need = lambda c: F.coalesce(c, F.raise_error(F.lit("a record lacks its text or url")).cast("string"))
    return of_parts(r.select("doc", F.array(part(":text", need(F.col("text"))), part(":url", need(F.col("url")))).alias("parts")), [":"])


def passage_records(spark: SparkSession, *paths: str) -> Collection:
    """JSON lines of pid and passage: :pid, and :paragraph around both."""
    r = _records(spark, paths, "pid string, passage string")
    return of_parts(r.select(doc_of(F.col("pid")).alias("doc"), F.array(part(":pid", F.col("pid")), part("", F.col("passage"))).alias("parts")), [":paragraph"])


def titled_records(spark: SparkSession, *paths: str) -> Collection:
    """JSON lines of id, title and contents: :pid, and :paragraph around all."""
    r = _records(spark, paths, "id string, title string, contents string")
    return of_parts(r.select(doc_of(F.col("id")).alias("doc"), F.array(part(":pid", F.col("id")), part("", F.col("title")), part("", F.col("contents"))).alias("parts")), [":paragraph"])


def news_records(spark: SparkSession, *paths: str) -> Collection:
    """JSON lines of news articles: :id, :title, :author, each paragraph with its own :pid and :paragraph, and :article around all."""
    r = _records(spark, paths, "id string, title string, author string, contents array<struct<content:string,blurb:string,fullcaption:string,subtype:string>>").where("id is not null")
    said = lambda x: F.concat_ws(" ", x["content"], x["blurb"], x["fullcaption"])
    full = F.filter(F.coalesce("contents", F.array().cast("array<struct<content:string,blurb:string,fullcaption:string,subtype:string>>")), lambda x: said(x) != "")

    def body(x, k):
        number = F.concat(F.lit("WAPO_"), F.col("id"), F.lit("-"), (k + 1).cast("string"))
        paragraph = F.array(part(":pid", number), part(":paragraph", said(x)))
        return F.when(x["subtype"] == "paragraph", paragraph).otherwise(F.array(part("", said(x))))

    head = F.array(part(":id", F.col("id")), part(":title", F.col("title")), part(":author", F.col("author")))
    return of_parts(r.select(doc_of(F.col("id")).alias("doc"), F.concat(head, F.flatten(F.transform(full, body))).alias("parts")), [":article"])


def object_records(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, path, kind, value, num, ok) of a dump with one JSON object a line, brackets and commas around lines allowed."""
    rows = readers.json_lines(spark, *paths).select(F.regexp_replace(F.trim("json"), ",$", "").alias("json")).where("json not in ('[', ']')")
    from . import jsonpaths

    return jsonpaths.flatten(rows.withColumn("id", F.get_json_object("json", "$.id")), "id", "json")


def raw_annotations(spark: SparkSession, *paths: str) -> DataFrame:
    """(feature hash, p, q, value bits) of files of records of four little-endian 64-bit numbers: the bulk format of annotations."""
    import struct
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [x for content in b["content"] for x in struct.iter_unpack("<qqqd", content[: len(content) // 32 * 32])]
            yield pd.DataFrame(rows, columns=["feature", "p", "q", "v"]).astype({"feature": "int64", "p": "int64", "q": "int64", "v": "float64"})

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInPandas(run, "feature long, p long, q long, v double")
