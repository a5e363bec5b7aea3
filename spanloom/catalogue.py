"""The registered queries: each a name, a Spark plan and, where SQL can say it, an independent formulation in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .functions import text as T
from .model import Collection
from .operators import evaluate as E
from .operators import intervals as I
from .operators import rank as R
from .operators import stats as S
from .plans.expr import Infix
from .sources import jsonpaths as J
from .sources import readers
from .streaming import store as versioned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- pieces of SQL

WORDS = "w AS (SELECT doc_id AS doc, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS ws FROM documents)"
TOK = WORDS + ", tok AS (SELECT doc, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w)"
SPLIT = "CASE WHEN regexp_matches(substr({0}, 2), '[A-Z]') THEN {0} ELSE lower({0}) END"
TERMS = TOK + f", term AS (SELECT doc, pos, {SPLIT.format('word')} AS term FROM tok), item AS (SELECT doc, len(ws) AS len FROM w WHERE len(ws) > 0)"
TF = TERMS + ", tf AS (SELECT doc, term, count(*) AS tf FROM term GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), tot AS (SELECT count(*) AS items, sum(len) AS length, sum(len) / count(*) AS avgl FROM item)"
TOPIC = f"tw AS (SELECT item_id AS topic, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM benchmark), topic AS (SELECT DISTINCT topic, {SPLIT.format('word')} AS term FROM tw)"
LINES = """ll AS (SELECT doc_id AS doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lc AS (SELECT doc, k, len(regexp_extract_all(line, '[A-Za-z0-9]+')) AS c FROM (SELECT doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM ll)),
le AS (SELECT doc, k, c, sum(c) OVER (PARTITION BY doc ORDER BY k) AS e FROM lc), line AS (SELECT doc, CAST(e - c AS BIGINT) AS p, CAST(e - 1 AS BIGINT) AS q, k AS n FROM le WHERE c > 0)"""


def posting(name: str, word: str) -> str:
    return f"{name} AS (SELECT doc, pos AS p, pos AS q FROM tok WHERE lower(word) = '{word}')"


def reduced(name: str, src: str) -> str:
    """name: the minimal intervals of src."""
    return f"""{name}_g AS (SELECT doc, p, min(q) AS q FROM ({src}) GROUP BY doc, p),
{name} AS (SELECT doc, p, q FROM (SELECT *, min(q) OVER (PARTITION BY doc ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM {name}_g) WHERE nx IS NULL OR nx > q)"""


A, B, C3 = "with", "from", "this"
AB = f"WITH {TOK}, {posting('a', A)}, {posting('b', B)}, {posting('c', C3)}"
AND_SRC = "SELECT a.doc, least(a.p, b.p) AS p, greatest(a.q, b.q) AS q FROM a JOIN b USING (doc)"
SEQ_SRC = "SELECT a.doc, a.p, b.q FROM a JOIN b ON a.doc = b.doc AND a.q < b.p"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_TEXTS = ("documents", "pages", "conversations", "events")
_INDEXES: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return shared.spread(df) if name in _TEXTS else df


def texts(spark: SparkSession, sf: str) -> Collection:
    """documents without an index: everything comes from the texts."""
    return Collection.of(table(spark, sf, "documents"), "doc_id", "text")


def documents(spark: SparkSession, sf: str) -> Collection:
    """documents with their stored index, which the first query of a session builds in the shared folder."""
    where = _INDEXES.setdefault((spark.sparkContext.applicationId, sf), shared.new_path(spark, "index"))
    return texts(spark, sf).indexed(where)


def with_lines(spark: SparkSession, sf: str) -> Collection:
    c = documents(spark, sf)
    return c.annotate(c.lines())


def benchmark_topics(spark: SparkSession, sf: str) -> DataFrame:
    return R.topics(table(spark, sf, "benchmark"), "item_id", "text")


def spans(df: DataFrame) -> DataFrame:
    return df.select("doc", "p", "q")


# --- tokenizers and scalar functions

query("tok_ascii", f"WITH {TOK} SELECT doc, pos, lower(word) AS feature FROM tok UNION ALL SELECT doc, pos, word AS feature FROM tok WHERE regexp_matches(substr(word, 2), '[A-Z]')")(lambda s, d: texts(s, d).tokens())
query("tok_split", f"WITH {TERMS} SELECT doc, pos, term FROM term")(lambda s, d: S.words(texts(s, d).docs).select("doc", F.posexplode("words").alias("pos", "term")).select("doc", F.col("pos").cast("long").alias("pos"), "term"))
query(
    "tok_xml",
    r"""WITH m AS (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), '</?[A-Za-z_][A-Za-z0-9_.\-]*[^\n>]*>|&[^ \n;]*;|[A-Za-z0-9]+'), lambda s: NOT starts_with(s, '&')) AS ws FROM pages),
    t AS (SELECT page_id, unnest(ws) AS s, generate_subscripts(ws, 1) - 1 AS pos FROM m)
    SELECT page_id, pos, CASE WHEN starts_with(s, '<') THEN regexp_extract(s, '^</?[A-Za-z0-9_.\-]+') || '>' WHEN regexp_matches(substr(s, 2), '[A-Z]') THEN s ELSE lower(s) END AS feature FROM t""",
)(lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(T.xml_split(F.coalesce("html", F.lit("")))).alias("pos", "feature")).select("page_id", F.col("pos").cast("long").alias("pos"), "feature"))
query(
    "tok_utf8",
    r"""WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{17000}-\x{187F7}\x{18D00}-\x{18D08}\x{20000}-\x{323AF}\x{FDD0}-\x{FDEF}]|\p{So}|[\p{L}\p{M}\p{N}]+') AS ws FROM documents)
    SELECT doc_id, unnest(ws).lower() AS token, generate_subscripts(ws, 1) - 1 AS pos FROM m""",
)(lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(T.utf8_split(F.coalesce("text", F.lit("")))).alias("pos", "token")).select("doc_id", "token", F.col("pos").cast("long").alias("pos")))
query("vocab_counts", f"WITH {TOK}, f AS (SELECT lower(word) AS feature FROM tok UNION ALL SELECT word FROM tok WHERE regexp_matches(substr(word, 2), '[A-Z]')) SELECT feature, count(*) AS count FROM f GROUP BY feature")(lambda s, d: texts(s, d).counts())
query("txt_tokens", f"WITH {TERMS} SELECT count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, min(len) AS shortest, max(len) AS longest FROM item")(
    lambda s, d: texts(s, d).lengths().where("length > 0").agg(F.count("*").alias("docs"), F.sum("length").alias("tokens"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
)
query("txt_translate", r"SELECT doc_id AS doc, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z0-9]+[^A-Za-z0-9]*'), 3, 6), '') AS content FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9]+')) >= 6")(
    lambda s, d: texts(s, d).translate(texts(s, d).lengths().where("length >= 6").select("doc", F.lit(2).alias("p"), F.lit(5).alias("q"))).select("doc", "content")
)
query("tok_skip", r"WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+[^A-Za-z0-9]*') AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(ws) > 3 THEN array_to_string(list_slice(ws, 4, len(ws)), '') ELSE '' END AS rest FROM m")(
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", T.skip_words(F.col("text"), 3).alias("rest"))
)
query("str_split", r"SELECT conv_id, turn, len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(text, '\S+')) AS n_fields FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.size(T.split_lines(F.col("text"))).cast("long").alias("n_lines"), F.size(T.split_tsv(F.col("text"), "")).cast("long").alias("n_fields"))
)
query("docno_clean", "SELECT doc_id, source || '-' || doc_id AS docno FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", T.docno(F.concat(F.lit(' <DOCNO> "'), "source", F.lit('"-'), "doc_id", F.lit(" </DOCNO> x"))).alias("docno"))
)
query("path_okay", "SELECT page_id, CASE WHEN contains(url, '/') THEN url ELSE './' || url END AS path, url LIKE '%1' AS truthy, regexp_extract(url, '[^/]+$') AS bare FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", T.normal_path(F.col("url")).alias("path"), T.okay(F.when(F.col("url").endswith("1"), "okay").otherwise("not okay")).alias("truthy"), F.regexp_replace(T.normal_path(F.regexp_extract("url", "[^/]+$", 0)), "^\\./", "").alias("bare"))
)

# --- cursor primitives, postings and counts

query("scan_feature", f"WITH {TOK} SELECT doc, pos AS p, pos AS q FROM tok WHERE lower(word) = '{A}'")(lambda s, d: spans(documents(s, d).term(A)))
query("idx_count", f"WITH {TOK} SELECT lower(word) AS feature, count(*) AS count FROM tok WHERE lower(word) IN ('{A}', '{B}', '{C3}') GROUP BY 1")(lambda s, d: documents(s, d).index.counts([A, B, C3]))
query("idx_vocab", f"WITH {TOK}, f AS (SELECT lower(word) AS feature FROM tok UNION SELECT word FROM tok WHERE regexp_matches(substr(word, 2), '[A-Z]')) SELECT count(*) AS vocab FROM f")(lambda s, d: documents(s, d).index.vocabulary())
query("idx_value_histogram", f"WITH {LINES} SELECT n AS value, count(*) AS count FROM line GROUP BY n")(lambda s, d: documents(s, d).lines().groupBy(F.col("n").alias("value")).agg(F.count("*").alias("count")))
_PROBE = {"tau": ("min", "p >= line.p", "p"), "rho": ("min", "q >= line.q", "p"), "uat": ("max", "q <= line.q", "p"), "ohr": ("max", "p <= line.p", "p")}
for _m, (_f, _on, _x) in _PROBE.items():
    _k = "p" if _m in ("tau", "ohr") else "q"
    query(f"cursor_{_m}", f"WITH {TOK}, {posting('a', A)}, {LINES}, k AS (SELECT DISTINCT doc, {_k} AS k FROM line) SELECT k.doc, k.k, {_f}(a.p) AS p FROM k LEFT JOIN a ON a.doc = k.doc AND a.{_on.replace('line.p', 'k.k').replace('line.q', 'k.k')} GROUP BY k.doc, k.k")(
        lambda s, d, m=_m, k=_k: I.probe(documents(s, d).term(A), documents(s, d).lines().select("doc", F.col(k).alias("k")).distinct(), m).select("doc", "k", "p")
    )

# --- the interval algebra

query("gcl_term", f"{AB} SELECT doc, p, q FROM a")(lambda s, d: spans(documents(s, d).gcl(A)))
query("gcl_or", f"{AB} SELECT doc, p, q FROM a UNION SELECT doc, p, q FROM b")(lambda s, d: spans(documents(s, d).gcl(f"(+ {A} {B})")))
query("gcl_and", f"{AB}, {reduced('r', AND_SRC)} SELECT * FROM r")(lambda s, d: spans(documents(s, d).gcl(f"(^ {A} {B})")))
query("gcl_followed_by", f"{AB}, {reduced('r', SEQ_SRC)} SELECT * FROM r")(lambda s, d: spans(documents(s, d).gcl(f"(... {A} {B})")))
for _n, _op, _not in (("gcl_contained_in", "<<", ""), ("gcl_not_contained_in", "!<", "NOT")):
    query(_n, f"{AB}, {LINES}, {reduced('r', SEQ_SRC)} SELECT doc, p, q FROM r WHERE {_not} EXISTS (SELECT 1 FROM line WHERE line.doc = r.doc AND line.p <= r.p AND r.q <= line.q)")(lambda s, d, op=_op: spans(with_lines(s, d).gcl(f"({op} (... {A} {B}) line:)")))
for _n, _op, _not in (("gcl_containing", ">>", ""), ("gcl_not_containing", "!>", "NOT")):
    query(_n, f"{AB}, {LINES}, {reduced('r', SEQ_SRC)} SELECT doc, p, q, n FROM line WHERE {_not} EXISTS (SELECT 1 FROM r WHERE line.doc = r.doc AND line.p <= r.p AND r.q <= line.q)")(lambda s, d, op=_op: with_lines(s, d).gcl(f"({op} line: (... {A} {B}))").select("doc", "p", "q", "n"))
query("gcl_merge", f"{AB}, {LINES}, u AS (SELECT doc, p, q, n FROM line WHERE q - p < 20 UNION ALL SELECT doc, p, q, -1 FROM a) SELECT doc, p, q, max(n) AS n FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.doc = x.doc AND y.p >= x.p AND y.q <= x.q AND (y.p <> x.p OR y.q <> x.q)) GROUP BY doc, p, q")(
    lambda s, d: I.merge([documents(s, d).term(A).withColumn("n", F.lit(-1).cast("long")), I.width(documents(s, d).lines().select(I.COLUMNS), lambda w: w <= 20)]).select("doc", "p", "q", "n")
)
query("gcl_merge_n", f"{AB}, u AS (SELECT doc, p, q, 0 AS n FROM a UNION ALL SELECT doc, p, p + 1, 1 FROM a UNION ALL SELECT doc, p, q, 2 FROM b UNION ALL SELECT doc, p, q, 3 FROM a) SELECT doc, p, q, CAST(max(n) AS BIGINT) AS n FROM u WHERE p = q GROUP BY doc, p, q")(
    lambda s, d: I.merge([x.withColumn("n", F.lit(i).cast("long")) for i, x in enumerate([documents(s, d).term(A), documents(s, d).term(A).withColumn("q", F.col("p") + 1), documents(s, d).term(B), documents(s, d).term(A)])]).select("doc", "p", "q", "n")
)
query("gcl_link", "SELECT DISTINCT o_custkey AS p, o_custkey AS q FROM orders WHERE o_totalprice > 100000")(
    lambda s, d: I.link(table(s, d, "orders").where("o_totalprice > 100000").select(F.lit(0).cast("long").alias("doc"), F.col("o_orderkey").alias("p"), F.col("o_orderkey").alias("q"), F.lit(0.0).alias("v"), F.col("o_custkey").alias("n"))).select("p", "q")
)
query("gcl_materialize", f"{AB}, {reduced('r', AND_SRC)}, {reduced('t', 'SELECT r.doc, r.p, c.q FROM r JOIN c ON r.doc = c.doc AND r.q < c.p')} SELECT * FROM t")(lambda s, d: spans(documents(s, d).gcl(f"(... (materialize (^ {A} {B})) {C3})")))
query("gcl_fixed", f"{AB}, {reduced('r', SEQ_SRC)} SELECT DISTINCT doc, x AS p, x + 3 AS q FROM (SELECT doc, unnest(range(p, q - 2)) AS x FROM r WHERE q - p >= 3)")(lambda s, d: spans(documents(s, d).gcl(f"(<< (# 4) (... {A} {B}))")))
query("gcl_fixed_containing", f"{AB}, {reduced('r', SEQ_SRC)}, n AS (SELECT doc, len(ws) AS len FROM w) SELECT DISTINCT doc, x AS p, x + 9 AS q FROM (SELECT doc, len, unnest(range(greatest(0, q - 9), p + 1)) AS x FROM r JOIN n USING (doc) WHERE q - p <= 9) WHERE x + 10 <= len")(
    lambda s, d: spans(documents(s, d).gcl(f"(>> (# 10) (... {A} {B}))"))
)
query("gcl_within_width", f"{AB}, {reduced('r', AND_SRC)} SELECT * FROM r WHERE q - p + 1 <= 5")(lambda s, d: spans(documents(s, d).gcl(f"(<< (^ {A} {B}) (# 5))")))
query("gcl_phrase", f"WITH {TOK} SELECT x.doc, x.pos AS p, y.pos AS q FROM tok x JOIN tok y ON x.doc = y.doc AND y.pos = x.pos + 1 WHERE lower(x.word) = 'of' AND lower(y.word) = 'the'")(lambda s, d: spans(documents(s, d).gcl('"of the"')))
query("gcl_n_of_m", f"{AB}, {reduced('r', AND_SRC + ' UNION ALL ' + AND_SRC.replace('b.', 'c.').replace('JOIN b', 'JOIN c') + ' UNION ALL ' + AND_SRC.replace('a.', 'c.').replace('FROM a', 'FROM c'))} SELECT * FROM r")(lambda s, d: spans(documents(s, d).gcl(f"(2 {A} {B} {C3})")))
query("gcl_intersect", f"{AB}, {reduced('r', AND_SRC)}, {reduced('t', SEQ_SRC)} SELECT * FROM r INTERSECT SELECT * FROM t")(lambda s, d: spans(documents(s, d).gcl(f"(>> (<< (^ {A} {B}) (... {A} {B})) (... {A} {B}))")))
query("gcl_except", f"{AB}, {reduced('r', AND_SRC)}, {reduced('t', SEQ_SRC)} SELECT * FROM r EXCEPT SELECT * FROM t")(
    lambda s, d: spans(documents(s, d).gcl(f"(!< (^ {A} {B}) (>> (<< (^ {A} {B}) (... {A} {B})) (... {A} {B})))"))
)


@query("gcl_infix", f"{AB}, {reduced('r', AND_SRC)} SELECT * FROM r WHERE q - p + 1 <= 10")
def gcl_infix(s, d):
    session = Infix()
    session.read(f'near = "{A}" and "{B}"')
    return spans(documents(s, d).infix("near < [10]", session))


query("addr_base", f"WITH {WORDS}, l AS (SELECT doc, len(ws) AS length FROM w) SELECT doc, CAST(coalesce(sum(length) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, length FROM l")(lambda s, d: texts(s, d).bases(8))
query(
    "gcl_global",
    f"""WITH {TOK}, l AS (SELECT doc, len(ws) AS length FROM w), b AS (SELECT doc, CAST(coalesce(sum(length) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM l),
    x AS (SELECT pos + base AS p, lower(word) AS f FROM tok JOIN b USING (doc) WHERE lower(word) IN ('{A}', '{B}')), y AS (SELECT p, f, lead(p) OVER (ORDER BY p) AS q, lead(f) OVER (ORDER BY p) AS g FROM x)
    SELECT p, q FROM y WHERE f = '{A}' AND g = '{B}'""",
)(lambda s, d: I.followed_by(documents(s, d).globalize(documents(s, d).term(A)), documents(s, d).globalize(documents(s, d).term(B))).select("p", "q"))

# --- statistics

query("stat_tf", f"WITH {TF} SELECT doc, term, tf FROM tf")(lambda s, d: documents(s, d).stats().tf().select("doc", "term", "tf"))
query("stat_df", f"WITH {TF} SELECT term, df FROM df")(lambda s, d: S.df(texts(s, d).docs))
query("stat_totals", f"WITH {TF} SELECT items, CAST(length AS BIGINT) AS length, round(avgl, 6) AS avgl FROM tot")(lambda s, d: documents(s, d).stats().totals().withColumn("avgl", F.round("avgl", 6)))


def _weights(s, d):
    index = documents(s, d).index
    return index.weights(index.tf()).crossJoin(F.broadcast(index.totals()))  # totals is one row


query("stat_idf", f"WITH {TF} SELECT term, round(greatest(ln(items / df), 0), 6) AS idf FROM df, tot")(lambda s, d: _weights(s, d).select("term", F.round(S.idf(F.col("items"), F.col("df")), 6).alias("idf")))
query("stat_rsj", f"WITH {TF} SELECT term, round(greatest(ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0), 6) AS rsj FROM df, tot")(lambda s, d: _weights(s, d).select("term", F.round(S.rsj(F.col("items"), F.col("df")), 6).alias("rsj")))
_FEATURE = "f AS (SELECT lower(word) AS feature FROM tok UNION ALL SELECT word FROM tok WHERE regexp_matches(substr(word, 2), '[A-Z]')), fc AS (SELECT feature, count(*) AS count FROM f GROUP BY 1), nv AS (SELECT (SELECT sum(len(ws)) FROM w) + (SELECT count(*) FROM fc) AS nv)"


@query("stat_icf", f"WITH {TOK}, {_FEATURE} SELECT feature, round(ln(nv::DOUBLE / (count + 1)), 6) AS icf FROM fc, nv")
def stat_icf(s, d):
    index = documents(s, d).index
    counts, n = index.counts(), index.vocabulary().crossJoin(index.totals().select("length"))
    return counts.crossJoin(F.broadcast(n)).select("feature", F.round(S.icf(F.col("length") + F.col("vocab"), F.col("count")), 6).alias("icf"))


def page_fields(s, d):
    p = table(s, d, "pages")
    title = p.select(F.col("page_id").alias("doc"), F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1).alias("text"))
    return {"title": title, "url": p.select(F.col("page_id").alias("doc"), F.coalesce("url", F.lit("")).alias("text"))}


_FIELDS = f"""fw AS (SELECT page_id AS doc, 'title' AS field, unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[A-Za-z0-9]+')) AS word FROM pages UNION ALL SELECT page_id, 'url', unnest(regexp_extract_all(url, '[A-Za-z0-9]+')) FROM pages),
ft AS (SELECT doc, {SPLIT.format('word')} AS term, field, count(*) AS tf FROM fw GROUP BY ALL)"""
query("stat_field_tf", f"WITH {_FIELDS} SELECT doc, term, field, tf FROM ft")(lambda s, d: S.field_tf(page_fields(s, d)))
query("stat_tf_range", f"WITH {TERMS} SELECT doc, term, count(*) AS tf FROM term WHERE pos >= 10 AND pos < 60 GROUP BY ALL")(
    lambda s, d: S.words(texts(s, d).docs).select("doc", F.explode(F.slice("words", 11, 50)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
)
query("forage_tf_idf", f"WITH {TOK}, {LINES}, t AS (SELECT l.doc, l.p, lower(word) AS term, count(*) AS n FROM line l JOIN tok ON tok.doc = l.doc AND pos BETWEEN l.p AND l.q GROUP BY ALL) SELECT 'tf:' || term AS feature, doc, p, p AS q, n FROM t UNION ALL SELECT 'df:' || term, min(doc), 0, 0, count(*) FROM t GROUP BY term")(
    lambda s, d: versioned.forage(texts(s, d), texts(s, d).lines(), versioned.tf_idf_forager).select("feature", "doc", "p", "q", "n")
)

# --- ranking

_RANK = "row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc) AS rank"
_BM25 = f"""WITH {TF}, {TOPIC}, s AS (SELECT topic, doc, round(sum(ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (0.5::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * len / avgl) + tf)), 6) AS score
FROM topic JOIN tf USING (term) JOIN df USING (term) JOIN item USING (doc), tot WHERE ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 GROUP BY topic, doc),
bm AS (SELECT * FROM (SELECT *, {_RANK} FROM s WHERE score > 0) WHERE rank <= 1000)"""
query("rank_bm25", f"{_BM25} SELECT topic, doc, score, rank FROM bm")(lambda s, d: R.bm25(documents(s, d).index, benchmark_topics(s, d)))
_LMD = f"""ctf AS (SELECT term, sum(tf) AS ctf FROM tf GROUP BY term), l AS (SELECT topic, doc, round(sum(ln(2000 + tf * length::DOUBLE / ctf) - ln(2000 + len)), 6) AS score FROM topic JOIN tf USING (term) JOIN ctf USING (term) JOIN item USING (doc), tot GROUP BY topic, doc),
lm AS (SELECT * FROM (SELECT *, {_RANK} FROM l) WHERE rank <= 1000)"""
query("rank_lmd", f"WITH {TF}, {TOPIC}, {_LMD} SELECT topic, doc, score, rank FROM lm")(lambda s, d: R.lmd(documents(s, d).index, benchmark_topics(s, d)))
query("rank_bm25_scan", f"{_BM25} SELECT topic, doc, score, rank FROM bm")(lambda s, d: R.bm25(texts(s, d).docs, benchmark_topics(s, d)))
query(
    "rank_bm25f",
    f"""WITH {_FIELDS}, ln0 AS (SELECT page_id AS doc FROM pages), lens AS (SELECT doc, count(word) AS len FROM ln0 LEFT JOIN fw USING (doc) GROUP BY doc), wt AS (SELECT doc, term, sum(CASE field WHEN 'title' THEN 3.0 ELSE 0.5 END * tf)::DOUBLE AS tf FROM ft GROUP BY ALL),
    n AS (SELECT count(*) AS items, avg(len) AS avgl FROM lens WHERE len > 0), dfr AS (SELECT term, count(*) AS df FROM wt GROUP BY term), topic AS (SELECT 0::BIGINT AS topic, unnest(['org', 'the', 'page', 'en', 'de', '12', '3']) AS term),
    s AS (SELECT topic, doc, round(sum(ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (0.5::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * len / avgl) + tf)), 6) AS score FROM topic JOIN wt USING (term) JOIN dfr USING (term) JOIN lens USING (doc), n WHERE ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 GROUP BY topic, doc)
    SELECT topic, doc, score, rank FROM (SELECT *, {_RANK} FROM s WHERE score > 0) WHERE rank <= 1000""",
)(lambda s, d: R.bm25f(page_fields(s, d), {"title": 3.0, "url": 0.5}, s.createDataFrame([(0, t, 1.0) for t in ("org", "the", "page", "en", "de", "12", "3")], "topic long, term string, w double")))
_SSR = f"""{AB}, {{lines}}{reduced('r', AND_SRC)}, s AS (SELECT doc, {{cp}} AS cp, round(sum(1 / (42::DOUBLE + r.q - r.p)), 6) AS score, arg_min(r.p, (r.q - r.p) * 1000000000 + r.p) AS p, arg_min(r.q, (r.q - r.p) * 1000000000 + r.p) AS q FROM r {{join}} {{where}} GROUP BY doc, {{cp}})
SELECT 0::BIGINT AS topic, doc, cp, p, q, score, row_number() OVER (ORDER BY score DESC, doc, cp) AS rank FROM s QUALIFY rank <= 1000"""
query("rank_ssr", _SSR.format(lines="", cp="0::BIGINT", join="", where=""))(lambda s, d: R.ssr(documents(s, d), f"(^ {A} {B})"))
query("ssr_range", _SSR.format(lines="", cp="0::BIGINT", join="", where="WHERE r.p >= 100 AND r.q < 1000"))(lambda s, d: R.ssr(documents(s, d), f"(^ {A} {B})", start=100, end=1000))
query(
    "ssr_lines",
    f"{AB}, {LINES}, {reduced('r', AND_SRC)}, s AS (SELECT r.doc, l.p AS cp, round(sum(1 / (42::DOUBLE + r.q - r.p)), 6) AS score, arg_min(r.p, (r.q - r.p) * 1000000000 + r.p) AS p, arg_min(r.q, (r.q - r.p) * 1000000000 + r.p) AS q FROM r JOIN line l ON l.doc = r.doc AND l.p <= r.p AND r.q <= l.q GROUP BY r.doc, l.p) SELECT 0::BIGINT AS topic, doc, cp, p, q, score, row_number() OVER (ORDER BY score DESC, doc, cp) AS rank FROM s QUALIFY rank <= 1000",
)(lambda s, d: R.ssr(documents(s, d), f"(^ {A} {B})", documents(s, d).lines().select(I.COLUMNS)))


def _sparse(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), "label", F.posexplode("embedding").alias("k", "x"))
    return e.select("doc", "label", F.col("k").cast("string").alias("term"), F.floor(F.col("x").cast("double") * 100).cast("long").alias("v")).where("v > 0")


@query(
    "rank_product",
    """WITH e AS (SELECT vec_id AS doc, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), sp AS (SELECT doc, label, k, CAST(floor(x::DOUBLE * 100) AS BIGINT) AS v FROM e WHERE floor(x::DOUBLE * 100) > 0),
    q AS (SELECT sp.label::BIGINT AS topic, k, v AS w FROM sp JOIN (SELECT label, min(vec_id) AS doc FROM embeddings GROUP BY label) USING (doc)), s AS (SELECT topic, sp.doc, sum(w * v)::DOUBLE AS score FROM q JOIN sp USING (k) GROUP BY topic, sp.doc)
    SELECT topic, doc, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 1000""",
)
def rank_product(s, d):
    sparse = _sparse(s, d)
    first = table(s, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("doc")).select("doc")
    queries = sparse.join(first, "doc").select(F.col("label").cast("long").alias("topic"), "term", F.col("v").cast("double").alias("w"))
    return R.product(sparse.select("doc", "term", "v"), queries)


query("rrf", f"{_BM25}, {_LMD}, u AS (SELECT topic, doc, rank FROM bm UNION ALL SELECT topic, doc, rank FROM lm), f AS (SELECT topic, doc, round(sum(1 / (60::DOUBLE + rank)), 6) AS score FROM u GROUP BY topic, doc) SELECT topic, doc, score, {_RANK} FROM f QUALIFY rank <= 1000")(
    lambda s, d: R.rrf([R.bm25(documents(s, d).index, benchmark_topics(s, d)), R.lmd(documents(s, d).index, benchmark_topics(s, d))])
)
query("topk", "SELECT o_custkey AS topic, o_orderkey AS doc, round(o_totalprice, 6) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 6) DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")(
    lambda s, d: R.top(table(s, d, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("score")), 3)
)
query("topk_dedupe", "WITH m AS (SELECT o_orderpriority AS topic, o_custkey AS doc, round(max(o_totalprice), 6) AS score FROM orders GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc) AS rank FROM m QUALIFY rank <= 20")(
    lambda s, d: R.top(table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("topic"), F.col("o_custkey").alias("doc")).agg(F.max("o_totalprice").alias("score")), 20)
)
_TIER = f"""{AB}, {reduced('r0', SEQ_SRC)}, {reduced('r1', AND_SRC)}, u AS (SELECT 0 AS tier, * FROM r0 UNION ALL SELECT 1, * FROM r1),
s AS (SELECT tier, doc, round(sum(1 / (42::DOUBLE + q - p)), 6) AS score, arg_min(p, (q - p) * 1000000000 + p) AS p, arg_min(q, (q - p) * 1000000000 + p) AS q FROM u GROUP BY tier, doc),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY tier) = 1) SELECT doc, tier, p, q, score, row_number() OVER (ORDER BY tier, score DESC, doc) AS rank FROM f QUALIFY rank <= 100000"""
query("tiered", _TIER)(lambda s, d: R.tiered(documents(s, d), [f"(... {A} {B})", f"(^ {A} {B})"], depth=100000).drop("cp"))
_ICF = {A: 4.0, B: 4.25, C3: 5.0}
query(
    "prf_rsj",
    f"{_BM25}, fb AS (SELECT topic, term, count(*) AS f FROM bm JOIN tf USING (doc) WHERE rank <= 10 GROUP BY ALL), t AS (SELECT topic, term, round(f * greatest(ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0), 6) AS tsv FROM fb JOIN df USING (term), tot) SELECT topic, term, tsv, row_number() OVER (PARTITION BY topic ORDER BY tsv DESC, term) AS rank FROM t WHERE tsv > 0 QUALIFY rank <= 25",
)(lambda s, d: R.rsj_feedback(documents(s, d).index, R.bm25(documents(s, d).index, benchmark_topics(s, d))))
query(
    "prf_kld",
    f"{_BM25}, {_FEATURE}, fb AS (SELECT topic, term, len FROM bm JOIN tf USING (doc) JOIN item USING (doc) WHERE rank <= 16), t AS (SELECT topic, term, count(*) AS f, sum(1 - pow(1 - (count + 1)::DOUBLE / nv, len)) AS e FROM fb JOIN fc ON fc.feature = fb.term, nv GROUP BY topic, term), u AS (SELECT topic, term, round(f * ln(f / e), 6) AS tsv FROM t WHERE f > 1) SELECT topic, term, tsv, row_number() OVER (PARTITION BY topic ORDER BY tsv DESC, term) AS rank FROM u QUALIFY rank <= 8",
)(lambda s, d: R.kld_feedback(documents(s, d).index, R.bm25(documents(s, d).index, benchmark_topics(s, d))))
query("rank_stop", f"WITH {TOPIC}, l AS (SELECT * FROM topic WHERE term NOT IN ({', '.join(repr(x) for x in R.STOPWORDS)})) SELECT topic, term FROM l UNION ALL SELECT topic, term FROM topic WHERE topic NOT IN (SELECT topic FROM l)")(lambda s, d: _stopped(benchmark_topics(s, d)))


def _stopped(q: DataFrame) -> DataFrame:
    left = q.where(~F.col("term").isin(R.STOPWORDS))
    return left.unionByName(q.join(left.select("topic").distinct(), "topic", "left_anti")).select("topic", "term")


query("trec_run", f"{_BM25}, n AS (SELECT topic, count(*) AS n FROM bm GROUP BY topic) SELECT topic, rank, concat_ws(' ', topic, 'Q0', doc, rank, n + 1 - rank, 'run1') AS line FROM bm JOIN n USING (topic) UNION ALL SELECT DISTINCT topic, 1, topic || ' Q0 FAKE 1 1 run1' FROM topic WHERE topic NOT IN (SELECT topic FROM bm)")(
    lambda s, d: R.trec_run(R.settle(R.bm25(documents(s, d).index, benchmark_topics(s, d)))[0], "run1", benchmark_topics(s, d))
)


query("doc_fetch", "SELECT doc_id AS doc, text FROM documents WHERE contains(lower(text), 'license')")(lambda s, d: documents(s, d).docs.where(F.lower("text").contains("license")))
query("page_next", f"WITH {TOK}, {posting('a', A)} SELECT doc, p FROM a ORDER BY doc, p LIMIT 24 OFFSET 24")(lambda s, d: documents(s, d).gcl(A).orderBy("doc", "p").offset(24).limit(24).select("doc", "p"))

# --- JSON and separated values


def _events(s, d):
    return table(s, d, "events")


def _some_missing(s, d):
    """Documents of which some errors hold a path :odd:k: and others don't."""
    odd = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), F.struct(F.lit(1).alias("k")))
    return _events(s, d).select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), odd.alias("odd"))).alias("js"))


query("json_flatten", "SELECT event_id AS id, ':' AS path, 'object' AS kind, NULL::VARCHAR AS value, NULL::DOUBLE AS num, true AS ok FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, ':k:', 'number', json_extract_string(props, '$.k'), CAST(json_extract_string(props, '$.k') AS DOUBLE), true FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")(
    lambda s, d: J.flatten(_events(s, d), "event_id", "props")
)
query("json_value_stats", "WITH v AS (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT min(k) AS lo, round(avg(k), 6) AS mean, max(k) AS hi FROM v")(
    lambda s, d: _events(s, d).select(J.at(F.col("props"), ":k:").cast("double").alias("k")).agg(F.min("k").alias("lo"), F.round(F.avg("k"), 6).alias("mean"), F.max("k").alias("hi"))
)
query("json_count", "SELECT count(json_extract_string(props, '$.k')) AS n FROM events")(lambda s, d: _events(s, d).agg(F.count(J.at(F.col("props"), ":k:")).alias("n")))
query("json_path_eq", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")(lambda s, d: _events(s, d).where(J.at(F.col("props"), ":k:") == "7").select("event_id"))
query("json_path_absent", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND event_id % 3 = 0)")(lambda s, d: _some_missing(s, d).where(J.at(F.col("js"), ":odd:k:").isNull()).select("event_id"))
query("json_group_count", "SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 1")(lambda s, d: _events(s, d).groupBy(J.at(F.col("props"), ":k:").alias("value")).agg(F.count("*").alias("n")))


@query("json_explode", "SELECT o_custkey AS id, ':orders:[' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || ']:' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def json_explode(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))).alias("js"))
    return J.flatten(o, "o_custkey", "js").where("kind = 'number'").select("id", "path", "value")


query("json_date_filter", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL")(
    lambda s, d: table(s, d, "orders").where("o_orderdate >= timestamp'1995-01-01' and o_orderdate < timestamp'1997-01-01'").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count("*").alias("n"))
)
query("json_encode", r"""SELECT doc_id, '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS js FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", J.encode(F.col("text")).alias("js"))
)
query("json_translate", "SELECT event_id, props FROM events")(lambda s, d: _events(s, d).select("event_id", J.unmark(J.mark(F.col("props"))).alias("props")))


def _rows(s, d):
    c = table(s, d, "customer").select("c_custkey", F.concat_ws("\t", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("value"))
    return readers.separated(c)


query(
    "src_tsv",
    """WITH f AS (SELECT c_custkey AS id, unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value, unnest([0, 1, 2, 3]) AS j FROM customer)
    SELECT id, ':' || j || ':' AS feature, value FROM f UNION ALL SELECT c_custkey, ':', concat_ws(chr(9), c_custkey, c_name, c_nationkey, c_mktsegment) FROM customer""",
)(lambda s, d: readers.field_annotations(_rows(s, d), "c_custkey"))
query("tsv_lookup", "SELECT c_name AS value FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda s, d: _rows(s, d).where(F.get("fields", F.lit(3)) == "BUILDING").select(F.get("fields", F.lit(1)).alias("value")))
query("src_already_appended", "SELECT url AS source FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE contains(url, '/es/'))")(
    lambda s, d: readers.not_yet(table(s, d, "pages").select(F.col("url").alias("source")), table(s, d, "pages").where(F.col("url").contains("/es/")).select(F.col("url").alias("source")))
)
query("vocab_file", f"WITH {TOK} SELECT lower(word) AS feature, count(*) AS count FROM tok WHERE NOT regexp_matches(substr(word, 2), '[A-Z]') GROUP BY 1")(
    lambda s, d: table(s, d, "documents").select(F.explode(T.ascii_words(F.coalesce("text", F.lit("")))).alias("w")).where(~T.inner_capital(F.col("w"))).groupBy(F.lower("w").alias("feature")).agg(F.count("*").alias("count"))
)

# --- metrics: documents of a source by length, judged by their quality

_RUN = """r AS (SELECT source AS topic, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS len FROM documents WHERE source IS NOT NULL QUALIFY rank <= 1000),
m AS (SELECT greatest(max(quality), 1) AS m FROM labels), g AS (SELECT source AS topic, doc_id AS doc, (pow(2, greatest(quality, 0)) - 1) / pow(2, m) AS gain FROM labels JOIN documents USING (doc_id), m), j AS (SELECT r.*, coalesce(gain, 0) AS gain, CASE WHEN gain > 0 THEN 1 ELSE 0 END AS hit FROM r LEFT JOIN g USING (topic, doc))"""


def _run(s, d):
    docs = table(s, d, "documents").where("source is not null").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), "n_chars", F.size(T.ascii_words(F.coalesce("text", F.lit("")))).alias("len"))
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n_chars"), "doc"))).where("rank <= 1000").drop("n_chars")


def _qrels(s, d):
    q = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), F.col("quality").alias("grade"))
    return E.gains(q).select("topic", "doc", "gain")


def _round(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


query("eval_qrels_gain", f"WITH {_RUN} SELECT topic, doc, round(gain, 6) AS gain FROM g")(lambda s, d: _round(_qrels(s, d)))
_P = f"""WITH {_RUN}, c AS (SELECT *, sum(hit) OVER (PARTITION BY topic ORDER BY rank) AS sofar FROM j), rel AS (SELECT topic, count(*) AS rel FROM g WHERE gain > 0 GROUP BY topic),
e AS (SELECT topic, sum(CASE WHEN hit = 1 THEN sofar / rank ELSE 0 END) AS aps, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / 5 AS p05, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / 10 AS p10, sum(CASE WHEN rank <= 20 THEN hit ELSE 0 END) / 20 AS p20, coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0) AS rr, count(*) AS ret, sum(hit) AS rr_ret FROM c GROUP BY topic)"""
query("eval_ap", f"{_P} SELECT topic, round(aps / greatest(coalesce(rel, 0), 1), 6) AS ap, round(rr_ret / greatest(coalesce(rel, 0), 1), 6) AS recall FROM e LEFT JOIN rel USING (topic)")(lambda s, d: _round(E.precision(_run(s, d), _qrels(s, d)).select("topic", "ap", "recall")))
query("eval_pk", f"{_P} SELECT topic, round(p05, 6) AS p05, round(p10, 6) AS p10, round(p20, 6) AS p20 FROM e")(lambda s, d: _round(E.precision(_run(s, d), _qrels(s, d)).select("topic", "p05", "p10", "p20")))
query("eval_rr", f"{_P} SELECT topic, round(rr, 6) AS rr FROM e")(lambda s, d: _round(E.precision(_run(s, d), _qrels(s, d)).select("topic", "rr")))
_AT = "sum(gain * ln(2) / ln(rank + 1)) AS {0}, sum(CASE WHEN rank <= 5 THEN gain * ln(2) / ln(rank + 1) ELSE 0 END) AS {0}05, sum(CASE WHEN rank <= 10 THEN gain * ln(2) / ln(rank + 1) ELSE 0 END) AS {0}10, sum(CASE WHEN rank <= 20 THEN gain * ln(2) / ln(rank + 1) ELSE 0 END) AS {0}20"
query(
    "eval_ndcg",
    f"WITH {_RUN}, i AS (SELECT topic, gain, row_number() OVER (PARTITION BY topic ORDER BY gain DESC, doc) AS rank FROM g WHERE gain > 0), b AS (SELECT topic, {_AT.format('best')} FROM i GROUP BY topic), o AS (SELECT topic, {_AT.format('dcg')} FROM j GROUP BY topic) SELECT topic, "
    + ", ".join(f"round(dcg{k}, 6) AS dcg{k}, round(coalesce(dcg{k} / best{k}, 0), 6) AS ndcg{k}" for k in ("", "05", "10", "20"))
    + " FROM o LEFT JOIN b USING (topic)",
)(lambda s, d: _round(E.ndcg(_run(s, d), _qrels(s, d))))
query("eval_rbp", f"WITH {_RUN} SELECT topic, round(0.5 * sum(gain * pow(0.5, rank - 1)), 6) AS rbp50, round(0.05 * sum(gain * pow(0.95, rank - 1)), 6) AS rbp95 FROM j GROUP BY topic")(lambda s, d: _round(E.rbp(_run(s, d), _qrels(s, d))))
query(
    "eval_tbg",
    f"WITH {_RUN}, t AS (SELECT *, coalesce(sum(4.4::DOUBLE + (0.018::DOUBLE * len + 7.8::DOUBLE) * CASE WHEN gain > 0 THEN 0.64::DOUBLE ELSE 0.39::DOUBLE END) OVER (PARTITION BY topic ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM j) SELECT topic, round(sum(CASE WHEN gain > 0 THEN 0.64::DOUBLE * 0.77::DOUBLE * exp(-spent * ln(2) / 224) ELSE 0 END), 6) AS tbg FROM t GROUP BY topic",
)(lambda s, d: _round(E.tbg(_run(s, d), _qrels(s, d))))
query("eval_mean", f"WITH {_RUN}, x AS (SELECT topic, 0.5 * sum(gain * pow(0.5, rank - 1)) AS rbp50, 0.05 * sum(gain * pow(0.95, rank - 1)) AS rbp95 FROM j GROUP BY topic) SELECT round(avg(rbp50), 6) AS rbp50, round(avg(rbp95), 6) AS rbp95 FROM x")(lambda s, d: _round(E.mean(E.rbp(_run(s, d), _qrels(s, d)))))


def _other_run(s, d):
    docs = table(s, d, "documents").where("source is not null").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"))
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("doc")))).where("rank <= 1000")


query(
    "eval_med",
    f"""WITH {_RUN}, r2 AS (SELECT source AS topic, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents WHERE source IS NOT NULL QUALIFY rank <= 1000),
    b AS (SELECT topic, doc, r.rank AS a, r2.rank AS b FROM r FULL JOIN r2 USING (topic, doc)),
    s AS (SELECT topic, sum(CASE WHEN a <= coalesce(b, 1000000) THEN ln(2) / ln(a + 1) - coalesce(ln(2) / ln(b + 1), 0) ELSE 0 END) AS d1, sum(CASE WHEN b <= coalesce(a, 1000000) THEN ln(2) / ln(b + 1) - coalesce(ln(2) / ln(a + 1), 0) ELSE 0 END) AS d2,
    sum(CASE WHEN a <= coalesce(b, 1000000) THEN pow(0.5, a) - coalesce(pow(0.5, b), 0) ELSE 0 END) AS e1, sum(CASE WHEN b <= coalesce(a, 1000000) THEN pow(0.5, b) - coalesce(pow(0.5, a), 0) ELSE 0 END) AS e2,
    0.05 * sum(CASE WHEN a <= coalesce(b, 1000000) THEN pow(0.95, a - 1) - coalesce(pow(0.95, b - 1), 0) ELSE 0 END) AS f1, 0.05 * sum(CASE WHEN b <= coalesce(a, 1000000) THEN pow(0.95, b - 1) - coalesce(pow(0.95, a - 1), 0) ELSE 0 END) AS f2, greatest(count(a), count(b)) AS n FROM b GROUP BY topic)
    SELECT topic, round(greatest(d1, d2), 6) AS med_dcg, round(greatest(d1, d2) / list_sum(list_transform(range(1, n + 1), lambda x: ln(2) / ln(x + 1))), 6) AS med_ndcg, round(greatest(e1, e2), 6) AS med_rbp50, round(greatest(f1, f2), 6) AS med_rbp95 FROM s""",
)(lambda s, d: _round(E.med(_run(s, d), _other_run(s, d))))


def _trials(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("trial")).agg(F.avg("o_totalprice").alias("value"))


query("tune_best", "WITH t AS (SELECT o_orderpriority AS topic, year(o_orderdate) AS trial, avg(o_totalprice) AS value FROM orders GROUP BY ALL) SELECT topic, CAST(arg_max(trial, value) AS INTEGER) AS trial, round(max(value), 6) AS value FROM t GROUP BY topic")(lambda s, d: _round(E.tune_best(_trials(s, d))))
# whole numbers, shifted by a fraction that no mean here can end in: engines differ in the last bit of a mean, and halves would be rounded either way
query("eval_running_mean", "WITH o AS (SELECT o_orderkey AS step, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders) SELECT step, value, CAST(round(avg(value) OVER (ORDER BY step) + 0.123456) AS BIGINT) AS mean FROM o")(
    lambda s, d: E.running_mean(table(s, d, "orders").select(F.col("o_orderkey").alias("step"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))).withColumn("mean", F.round(F.col("mean") + 0.123456).cast("long"))
)
query("src_splade", "SELECT CAST(c_custkey AS VARCHAR) AS doc, 'n' AS term, CAST(c_nationkey AS BIGINT) AS v FROM customer WHERE c_nationkey > 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'k', c_custkey FROM customer WHERE c_custkey > 0")(
    lambda s, d: readers.sparse_vectors(table(s, d, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("docid"), F.struct(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"), F.lit(-1).alias("x"), F.lit(0.5).alias("y")).alias("splade_vector"))).alias("json")))
)
query("pref_triples", r"SELECT t.item_id AS topic, a.conv_id AS doc, b.conv_id AS worse, regexp_replace(t.text, '\s+', ' ', 'g') || chr(9) || regexp_replace(a.text, '\s+', ' ', 'g') || chr(9) || regexp_replace(b.text, '\s+', ' ', 'g') AS line FROM benchmark t JOIN conversations a ON a.conv_id = t.item_id AND a.turn = 0 JOIN conversations b ON b.conv_id = t.item_id + 1 AND b.turn = 0")(
    lambda s, d: E.training_triples(
        table(s, d, "benchmark").select(F.col("item_id").alias("topic"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("topic"), F.col("item_id").alias("doc"), (F.col("item_id") + 1).alias("worse")), table(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc"), "text")
    )
)

# --- the versioned store


def _scratch(spark: SparkSession) -> str:
    return shared.new_path(spark, "store")


def _store(s, d):
    st = versioned.Store(s, _scratch(s))
    docs = texts(s, d).docs
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (english, ~english):  # two commits
        st.begin().append(Collection.of(table(s, d, "documents").where(part), "doc_id", "text").docs).commit()
    st.begin().append(docs).abort()
    return st


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.length("text").cast("long").alias("chars"))


_ALL = "SELECT doc_id AS doc, length(coalesce(text, '')) AS chars FROM documents"
query("dyn_commit_visible", _ALL)(lambda s, d: _sizes(_store(s, d).snapshot().docs()))
query("dyn_snapshot", _ALL + " WHERE lang = 'en'")(lambda s, d: _sizes(_store(s, d).snapshot(1).docs()))


@query("dyn_erase", _ALL + " WHERE NOT (doc_id BETWEEN 10 AND 40 OR doc_id BETWEEN 30 AND 60)")
def dyn_erase(s, d):
    st = _store(s, d)
    st.begin().erase(10, 40).erase(30, 60).commit()
    return _sizes(st.snapshot().docs())


@query("dyn_compact", _ALL + " WHERE NOT doc_id BETWEEN 10 AND 40")
def dyn_compact(s, d):
    st = _store(s, d)
    st.begin().erase(10, 40).commit()
    st.compact()
    st.vacuum(older_than=0)
    return _sizes(st.snapshot().docs())


@query("dyn_stream_ingest", _ALL)
def dyn_stream_ingest(s, d):
    st = versioned.Store(s, _scratch(s))
    docs = table(s, d, "documents")
    stream = s.readStream.schema(docs.schema).parquet(f"{d}/documents.parque[t]").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    q = stream.writeStream.foreachBatch(versioned.commit_batches(st)).option("checkpointLocation", st.path + "-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return _sizes(st.snapshot().docs())

from . import catalogue_more  # noqa: E402, F401  registers further queries
