"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .exact_dedup import exact_dedup
from .licenses import scan_licenses
from .packing import pack_documents
from .secrets import scan_secrets
from .simhash import simhash_groups
from .substring_dedup import remove_repeats
from .token_counts import document_token_counts
from .toxicity import score_toxicity
from .unigram import encode_documents
from .vector_dedup import vector_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("n_points", "text_key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents are a tree of two levels here: a directory for each source."""
    return scan_licenses(_table(spark, sf_dir, "documents"), F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents")).drop("text_key", "component")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_token_counts, op3_toxicity, op4_substring_dedup, op5_vector_dedup,
        op6_license_scan, op7_sentencepiece, op8_secret_scan, op9_packing, op10_simhash,
    )
}


def _matches(name: str, pattern: str, group: int = 0) -> str:
    """name: (r, i, start, size, own), matches of a pattern in t of d, start counted by what stands between them; own: length of a group."""
    return rf"""{name}_l AS (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d),
        {name} AS (SELECT r, i, coalesce(list_sum(list_transform(list_slice(p, 1, i), lambda x: len(x))), 0) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: len(x))), 0) AS start, m[i] AS body, len(m[i]) AS size, len(g[i]) AS own
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_l))"""


_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = rf"""(?:{_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
        g AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        k AS (SELECT r, i, CASE WHEN i + 34 <= len(ws) THEN array_to_string(list_slice(ws, i, i + 34), ' ') END AS key FROM (SELECT r, ws, generate_subscripts(ws, 1) AS i FROM d)),
        again AS (SELECT r, i, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS again FROM k),
        c AS (SELECT r, i, w, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM t JOIN again USING (r, i)),
        s AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)""",
    "op5_vector_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(least(a, b)) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
        FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op8_secret_scan": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), {_matches("a", _ASSIGN, 1)}, {_matches("k", "AKIA[A-Z0-9]+")}, {_matches("h", "[0-9a-f]+")}, {_matches("c", "[A-Za-z0-9+/_=-]+")},
        base AS (SELECT r, 'assign' AS kind, 1 AS o, start, start + size AS stop FROM a WHERE own >= 8 UNION ALL SELECT r, 'access', 2, start, start + size FROM k WHERE size >= 16 UNION ALL SELECT r, 'hex', 3, start, start + size FROM h WHERE size >= 32),
        likely AS (SELECT *, CASE WHEN regexp_full_match(body, '[0-9a-fA-F]+') THEN 16 ELSE 20 END AS w, CASE WHEN regexp_full_match(body, '[0-9a-fA-F]+') THEN 2.9::DOUBLE WHEN regexp_full_match(body, '[A-Za-z0-9]+') THEN 3.6::DOUBLE ELSE 3.8::DOUBLE END AS least
            FROM c WHERE size >= 20 AND len(regexp_replace(body, '[^0-9]', '', 'g')) BETWEEN 2 AND size - 1 AND NOT regexp_matches(body, '(?i)example|sample|placeholder|changeme|your[-_]?(key|token|secret)|x{{6,}}|lorem')
            AND NOT regexp_full_match(body, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AND NOT (regexp_full_match(body, '(?:[A-Za-z]*[0-9]{{0,4}}[/_=-])*[A-Za-z]*[0-9]{{0,4}}') AND NOT ends_with(body, '='))),
        dense AS (SELECT r, start, start + size AS stop FROM likely l WHERE list_max(list_transform(range(1, size - w + 2), lambda x: list_entropy(string_split(substr(body, x, w), '')))) >= least
            AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = l.r AND b.start < l.start + l.size AND b.stop > l.start)),
        every AS (SELECT * FROM base UNION ALL SELECT r, 'entropy', 4, start, stop FROM dense),
        s AS (SELECT r, count(*) FILTER (WHERE o = 1) AS n_assign, count(*) FILTER (WHERE o = 2) AS n_access, count(*) FILTER (WHERE o = 3) AS n_hex, count(*) FILTER (WHERE o = 4) AS n_entropy,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (WHERE o < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans FROM every GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (r)""",
}
