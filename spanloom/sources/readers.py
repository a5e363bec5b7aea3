"""Readers of text, JSON lines, separated values, markup, run and judgement files, as DataFrames with their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import jsonpaths


def _file() -> F.Column:
    return F.col("_metadata.file_path").alias("source")


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, text), one row per file; compressed files are read by their extension."""
    return spark.read.text(list(paths), wholetext=True).select(_file(), F.col("value").alias("text"))


def json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, json), one row per line that isn't blank."""
    return spark.read.text(list(paths)).select(_file(), F.col("value").alias("json")).where(F.trim("json") != "")


def json_annotations(spark: SparkSession, *paths: str) -> DataFrame:
    """jsonpaths.flatten() of every line, its id the number of the line, and for each a row of kind source: path "/" and the file's path."""
    rows = json_lines(spark, *paths).withColumn("id", F.monotonically_increasing_id())
    source = rows.select("id", F.lit("/").alias("path"), F.lit("source").alias("kind"), T.normal_path(F.col("source")).alias("value"), F.lit(None).cast("double").alias("num"), F.lit(True).alias("ok"))
    return jsonpaths.flatten(rows, "id", "json").unionByName(source)


def separated(lines: DataFrame, line: str = "value", sep: str = "\t") -> DataFrame:
    """lines with `fields`; an empty separator splits at white space."""
    return lines.withColumn("fields", T.split_tsv(F.col(line), sep))


def tsv_files(spark: SparkSession, *paths: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """(source, fields, is_header): the first line of each file is its header if there is one."""
    rows = spark.read.text(list(paths)).select(_file(), "value", F.monotonically_increasing_id().alias("k"))
    rows = separated(rows, "value", sep)
    if not header:
        return rows.select("source", "fields", F.lit(False).alias("is_header"))
    first = rows.groupBy("source").agg(F.min("k").alias("first"))
    return rows.join(first, "source").select("source", "fields", (F.col("k") == F.col("first")).alias("is_header"))


def field_annotations(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, feature, value): field j as :j:, the record as : ."""
    each = rows.select(F.col(id_col).alias("id"), F.posexplode("fields").alias("j", "value"))
    whole = rows.select(F.col(id_col).alias("id"), F.lit(":").alias("feature"), F.array_join("fields", "\t").alias("value"))
    return each.select("id", F.concat(F.lit(":"), F.col("j"), F.lit(":")).alias("feature"), "value").unionByName(whole)


def not_yet(sources: DataFrame, known: DataFrame, on: str = "source") -> DataFrame:
    """sources whose normalised path isn't known."""
    return sources.withColumn(on, T.normal_path(F.col(on))).join(known.select(T.normal_path(F.col(on)).alias(on)).distinct(), on, "left_anti")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, text) of lines "topic<TAB or space>text"."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^(\S+)[\t ]+(.*)$", 1).alias("topic"), F.regexp_extract("value", r"^(\S+)[\t ]+(.*)$", 2).alias("text")).where("topic <> ''")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(topic, docno, grade) of lines of four fields; grades below 0 become 0."""
    f = T.split_tsv(F.col("value"), "")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == 4)
    return rows.select(F.get("f", F.lit(0)).alias("topic"), T.docno(F.get("f", F.lit(2))).alias("docno"), F.greatest(F.get("f", F.lit(3)).cast("int"), F.lit(0)).alias("grade"))


def duplicate_map(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, duplicate) of lines "canonical: duplicate, duplicate"."""
    rows = spark.read.text(path).select(F.split("value", ":", 2).alias("f")).where(F.size("f") == 2)
    return rows.select(F.trim(F.col("f")[0]).alias("canonical"), F.explode(F.split(F.col("f")[1], ",")).alias("duplicate")).select("canonical", F.trim("duplicate").alias("duplicate")).where("duplicate <> ''")


def sparse_vectors(rows: DataFrame, json_col: str = "json", id_key: str = "docid", vector_key: str = "splade_vector") -> DataFrame:
    """(doc, term, v) of JSON rows {docid, splade_vector: {dimension: weight}}: the positive whole weights."""
    parsed = rows.select(F.get_json_object(json_col, f"$.{id_key}").alias("doc"), F.from_json(F.get_json_object(json_col, f"$.{vector_key}"), "map<string,double>").alias("m"))
    return parsed.select("doc", F.explode("m").alias("term", "v")).where("v > 0 and v = floor(v)").withColumn("v", F.col("v").cast("long"))


def write_run(lines: DataFrame, path: str) -> None:
    lines.orderBy("topic", "rank").select("line").write.mode("overwrite").text(path)


def write_vocabulary(counts: DataFrame, path: str) -> None:
    """feature hash, count and term of each feature, as text."""
    counts.select(F.concat_ws(" ", F.xxhash64("feature"), "count", "feature")).write.mode("overwrite").text(path)
