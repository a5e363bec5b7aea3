"""From documents to packed token sequences: toxicity, exact and near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.llm.exact_dedup import representatives
from spanloom.llm.packing import pack_documents
from spanloom.llm.secrets import redact_secrets
from spanloom.llm.simhash import near_representatives
from spanloom.llm.toxicity import drop_toxic


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs that kept, (doc_id, text_key), names, null matching null; of repeated rows one stays.

    Rows go through one shuffle, on what tells them apart; their columns are in a
    struct meanwhile, so whatever their names are they clash with nothing.
    """
    by = lambda doc_id, key: (F.coalesce(doc_id, F.lit(0).cast("long")).alias("k1"), doc_id.isNull().alias("k2"), key.alias("k3"))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *by(F.col("doc_id").cast("long"), text))
    rows = rows.join(kept.select(*by(F.col("doc_id"), F.col("text_key"))), ["k1", "k2", "k3"], "left_semi")
    return rows.dropDuplicates(["k1", "k2", "k3"]).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts, repeated rows and null ids are scored like any other."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, null and empty ones being equal: the longest, then that of the smallest doc_id, null last."""
    return _only(docs, representatives(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id (null last), of each group of near duplicates."""
    return _only(docs, near_representatives(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew; null texts and everything else stay as they are."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids; a null or empty text is its end identifier alone."""
    return pack_documents(docs, with_ids=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_dedup", near), ("secret_scan", secrets), ("packing", packing)]

#: Training a classifier and hashing by random samples have no counterpart in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
