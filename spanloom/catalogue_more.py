"""Further registered queries: tiers, passages, feedback, answers, pipelines, trials, loaders, the store's index and the service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .catalogue import _BM25, _ICF, _RANK, A, AB, AND_SRC, B, C3, LINES, TERMS, TF, TOK, TOPIC, WORDS, _round, benchmark_topics, documents, query, reduced, spans, table, texts, with_lines
from .functions import stem
from .functions import text as T
from .model import Collection
from .operators import evaluate as E
from .operators import intervals as I
from .operators import rank as R
from .operators import stats as S
from .service import Service
from .sources import jsonpaths as J
from .sources import loaders, readers
from .streaming import store as versioned

# --- tiers: subsets of three words by the sum of their weights

_WORDS3 = f"('{A}'), ('{B}'), ('{C3}')"
_VOCAB = "voc AS (SELECT (SELECT sum(len(ws)) FROM w) + (SELECT count(*) FROM (SELECT lower(word) FROM tok UNION SELECT word FROM tok WHERE regexp_matches(substr(word, 2), '[A-Z]'))) AS nv)"
_SUBSETS = f"""{_VOCAB}, tc AS (SELECT t, (SELECT count(*) FROM tok WHERE lower(word) = t) AS c FROM (VALUES {_WORDS3}) x(t)), tw3 AS (SELECT t, ln(nv::DOUBLE / (c + 1)) AS wt FROM tc, voc),
tj AS (SELECT t, wt, row_number() OVER (ORDER BY wt DESC, t) - 1 AS j FROM tw3),
sub AS (SELECT m, sum(wt) AS wt, count(*) AS n, string_agg(t, ' ' ORDER BY j) AS ts FROM range(1, 8) r(m), tj WHERE (m >> j) & 1 = 1 GROUP BY m),
ord AS (SELECT *, row_number() OVER (ORDER BY wt DESC, m DESC) AS k, CASE WHEN n > 1 THEN '(^ ' || ts || ')' ELSE '(... ' || ts || ' ' || ts || ')' END AS q FROM sub),
tr AS (SELECT k, m, q, wt AS first, 0 AS tier FROM ord WHERE k = 1 UNION ALL SELECT o.k, o.m, o.q, CASE WHEN tr.first - o.wt < 1 THEN tr.first ELSE o.wt END, CASE WHEN tr.first - o.wt < 1 THEN tier ELSE tier + 1 END FROM tr JOIN ord o ON o.k = tr.k + 1)"""
query("tiers_build", f"WITH RECURSIVE {TOK}, {_SUBSETS} SELECT tier::BIGINT AS tier, CASE WHEN count(*) = 1 THEN min(q) ELSE '(+ ' || string_agg(q, ' ' ORDER BY k) || ')' END AS query FROM tr GROUP BY tier")(
    lambda s, d: s.createDataFrame(list(enumerate(R.build_tiers(documents(s, d), f"{A} {B} {C3}"))), "tier long, query string")
)
_COVERS = f"""occ AS (SELECT doc, pos AS p, lower(word) AS t FROM tok WHERE lower(word) IN (SELECT t FROM tj)),
one AS (SELECT doc, t, p, lead(p) OVER (PARTITION BY doc, t ORDER BY p) AS q FROM occ), last AS (SELECT doc, p AS q, j, max(CASE WHEN occ.t = tj.t THEN p END) OVER (PARTITION BY doc, j ORDER BY p) AS pl FROM occ, tj),
many AS (SELECT m, doc, min(pl) AS p, last.q FROM last JOIN ord ON n > 1 AND (m >> j) & 1 = 1 GROUP BY m, doc, last.q HAVING count(pl) = max(n)),
cov AS (SELECT tier, doc, p, many.q FROM many JOIN tr USING (m) UNION SELECT tier, doc, p, one.q FROM one JOIN ord ON n = 1 AND ts = t JOIN tr ON tr.m = ord.m WHERE one.q IS NOT NULL),
mini AS (SELECT * FROM cov x WHERE NOT EXISTS (SELECT 1 FROM cov y WHERE y.tier = x.tier AND y.doc = x.doc AND y.p >= x.p AND y.q <= x.q AND (y.p > x.p OR y.q < x.q)))"""
query(
    "tiered_auto",
    f"""WITH RECURSIVE {TOK}, {_SUBSETS}, {_COVERS}, s AS (SELECT tier, doc, round(sum(1 / (42::DOUBLE + q - p)), 6) AS score, arg_min(p, (q - p) * 1000000000 + p) AS p, arg_min(q, (q - p) * 1000000000 + p) AS q FROM mini GROUP BY tier, doc),
    c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY tier ORDER BY score DESC, doc) <= 1000), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY tier) = 1)
    SELECT doc, tier, p, q, score, row_number() OVER (ORDER BY tier, score DESC, doc) AS rank FROM f QUALIFY rank <= 1000""",
)(lambda s, d: R.tiered(documents(s, d), R.build_tiers(documents(s, d), f"{A} {B} {C3}")).drop("cp"))

# --- passages, answers, snippets

_ICOVER = f"""ic AS (SELECT * FROM (VALUES ('{A}', 4.0::DOUBLE), ('{B}', 4.25::DOUBLE), ('{C3}', 5.0::DOUBLE)) x(t, wt)), io AS (SELECT doc, pos AS p, lower(word) AS t FROM tok WHERE lower(word) IN (SELECT t FROM ic)),
il AS (SELECT doc, q, pl, wt FROM (SELECT doc, p AS q, wt, max(CASE WHEN io.t = ic.t THEN p END) OVER (PARTITION BY doc, ic.t ORDER BY p) AS pl FROM io, ic) WHERE pl IS NOT NULL),
ik AS (SELECT doc, q, pl AS p, row_number() OVER (PARTITION BY doc, q ORDER BY pl DESC) AS k, sum(wt) OVER (PARTITION BY doc, q ORDER BY pl DESC) AS wt FROM il),
iq AS (SELECT doc, k, p, min(q) AS q, arg_min(wt, q) AS wt FROM ik GROUP BY doc, k, p), ix AS (SELECT doc, k, p, q, round(wt - k * ln(q - p + 1), 6) AS score FROM iq),
ib AS (SELECT doc, p, q, score FROM ix QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, k, p) = 1), icover AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM ib WHERE score > 0)"""
query("rank_icover", f"WITH {TOK}, {_ICOVER} SELECT 0 AS topic, doc, p, q, score, rank FROM icover WHERE rank <= 1000")(lambda s, d: R.icover(documents(s, d), [A, B, C3], _ICF))
_UNIFORM = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296::DOUBLE"
query("rank_random", f"WITH r AS (SELECT doc_id AS doc, round({_UNIFORM.format("'0:' || doc_id")}, 6) AS score FROM documents) SELECT 0::BIGINT AS topic, doc, score, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM r WHERE score > 0 QUALIFY rank <= 1000")(lambda s, d: R.random_ranking(documents(s, d).docs))
_FC = "f AS (SELECT lower(word) AS feature FROM tok UNION ALL SELECT word FROM tok WHERE regexp_matches(substr(word, 2), '[A-Z]')), fc AS (SELECT feature, count(*) AS count FROM f GROUP BY 1), nv AS (SELECT (SELECT sum(len(ws)) FROM w) + (SELECT count(*) FROM fc) AS nv)"
_BEST = "SELECT doc, arg_min(p, (q - p) * 1000000000 + p) AS p, arg_min(q, (q - p) * 1000000000 + p) AS q, round(sum(1 / (42::DOUBLE + q - p)), 6) AS score FROM r GROUP BY doc"
query(
    "prf_qa",
    f"""WITH {TERMS}, {", ".join(f"{n} AS (SELECT doc, pos AS p, pos AS q FROM tok WHERE lower(word) = '{x}')" for n, x in (("a", A), ("b", B)))}, {reduced('r', AND_SRC)}, s AS ({_BEST}), c AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY score DESC, doc) <= 16), {_FC},
    n AS (SELECT doc, term, min(CASE WHEN pos < p THEN q - pos WHEN pos > q THEN pos - p - 1 ELSE q - p + 1 END) AS gap FROM c JOIN term USING (doc) WHERE pos BETWEEN p - 64 AND q + 64 GROUP BY ALL),
    t AS (SELECT term, count(*) AS f, sum(1 - pow(1 - (count + 1)::DOUBLE / nv, greatest(gap, 1))) AS e FROM n JOIN fc ON feature = term, nv GROUP BY term)
    SELECT 0::BIGINT AS topic, term, round(f * ln(f / e), 6) AS tsv, row_number() OVER (ORDER BY round(f * ln(f / e), 6) DESC, term) AS rank FROM t WHERE f > 1 QUALIFY rank <= 8""",
)(lambda s, d: R.qa_feedback(documents(s, d), R.ssr(documents(s, d), f"(^ {A} {B})")))
query(
    "qap",
    f"""WITH {TERMS}, {_ICOVER}, {_FC}, c AS (SELECT doc, p, q, rank, greatest(p - 64, 0) AS lo, least(q + 64, len - 1) AS hi FROM icover JOIN item USING (doc) WHERE rank <= 32),
    pw AS (SELECT doc, rank, pos - lo AS k, term, CASE WHEN pos < p THEN p - pos WHEN pos > q THEN pos - q ELSE 0 END AS gap, hi - lo + 1 AS n FROM c JOIN term USING (doc) WHERE pos BETWEEN lo AND hi),
    g AS (SELECT doc, term, min(gap) AS gap FROM pw GROUP BY ALL), v AS (SELECT term, pow(sum(ln(nv::DOUBLE / ((count + 1) * (gap + 1)))), 3) AS wt FROM g JOIN fc ON feature = term, nv WHERE term NOT IN ('{A}', '{B}', '{C3}') GROUP BY term),
    st AS (SELECT DISTINCT doc, rank, unnest(range(0, greatest(n - 64, 0) + 1)) AS s FROM pw), sw AS (SELECT DISTINCT st.doc, s, term FROM st JOIN pw ON pw.doc = st.doc AND k BETWEEN s AND s + 63),
    sc AS (SELECT doc, s, round(sum(coalesce(wt, 0)), 6) AS score FROM sw LEFT JOIN v USING (term) GROUP BY doc, s), b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, s) = 1),
    z AS (SELECT doc, string_agg(term, ' ' ORDER BY k) AS snippet, any_value(score) AS score FROM b JOIN pw USING (doc) WHERE k BETWEEN s AND s + 63 GROUP BY doc)
    SELECT doc, snippet, score, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM z QUALIFY rank <= 5""",
)(lambda s, d: R.qap(documents(s, d), [A, B, C3], _ICF))
query(
    "ssr_snippet",
    f"""{AB}, {reduced('r', AND_SRC)}, s AS ({_BEST}), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 1000), t AS (SELECT doc_id AS doc, regexp_extract_all(text, '[A-Za-z0-9]+[^A-Za-z0-9]*') AS ws FROM documents)
    SELECT doc, rank, array_to_string(list_slice(ws, greatest(p - 100, 0) + 1, p), '') || '<cover>' || array_to_string(list_slice(ws, p + 1, q + 1), '') || '</cover>' || array_to_string(list_slice(ws, q + 2, q + 101), '') AS snippet FROM k JOIN t USING (doc)""",
)(lambda s, d: Service({"all": documents(s, d)}).snippets(R.ssr(documents(s, d), f"(^ {A} {B})"), documents(s, d)).select("doc", "rank", "snippet"))

# --- pipelines and trials

_WEIGHTED = """sum(x.w * ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (0.5::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * len / avgl) + tf))"""
query(
    "pipeline_bm25_rsj_bm25",
    f"""{_BM25}, fb AS (SELECT topic, term, count(*) AS f FROM bm JOIN tf USING (doc) WHERE rank <= 10 GROUP BY ALL), t AS (SELECT topic, term, round(f * greatest(ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0), 6) AS tsv FROM fb JOIN df USING (term), tot),
    e AS (SELECT topic, term FROM t WHERE tsv > 0 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY tsv DESC, term) <= 25), x AS (SELECT topic, term, sum(w) AS w FROM (SELECT topic, term, 1::DOUBLE AS w FROM topic UNION ALL SELECT topic, term, 0.2::DOUBLE FROM e) GROUP BY ALL),
    s2 AS (SELECT x.topic, doc, round({_WEIGHTED}, 6) AS score FROM x JOIN tf USING (term) JOIN df USING (term) JOIN item USING (doc), tot WHERE ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 GROUP BY x.topic, doc)
    SELECT topic, doc, score, {_RANK} FROM s2 WHERE score > 0 QUALIFY rank <= 1000""",
)(lambda s, d: R.pipeline(documents(s, d).index, benchmark_topics(s, d), "bm25 rsj bm25"))


def _porter(words: str) -> str:
    """CTEs that stem the column word of `words`; the last is stems (word, stem)."""

    def shape(e: str) -> str:
        """V for vowels, C for consonants; y is what the letter before it isn't."""
        x = f"regexp_replace(regexp_replace(regexp_replace({e}, '[aeiou]', 'V', 'g'), '[b-df-hj-np-tv-xz]', 'C', 'g'), '^y', 'C')"
        for _ in range(6):
            x = f"replace(replace({x}, 'Cy', 'CV'), 'Vy', 'VC')"
        return x

    m = lambda k, s="s": f"len(regexp_extract_all(left({s}, len({s}) - {k}), 'V+C+'))"
    cut = lambda k, more="": f"left(w, len(w) - {k})" + (f" || '{more}'" if more else "")
    cvc = lambda k: f"(right(left(s, len(s) - {k}), 3) = 'CVC' AND substr(w, len(w) - {k}, 1) NOT IN ('w', 'x', 'y'))"
    ends = lambda e: f"ends_with(w, '{e}')"

    def table(t: dict, least: int, also: str = "true") -> str:
        rows = sorted(t.items(), key=lambda x: -len(x[0]))
        return "CASE " + " ".join(f"WHEN {ends(e)} THEN CASE WHEN {m(len(e))} > {least} AND {also if e == 'ion' else 'true'} THEN {cut(len(e), to)} ELSE w END" for e, to in rows) + " ELSE w END"

    vowel = lambda k: f"contains(left(s, len(s) - {k}), 'V')"
    steps = [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {m(3)} > 0 THEN {cut(1)} ELSE w END WHEN {ends('ed')} THEN CASE WHEN {vowel(2)} THEN {cut(2)} || '+' ELSE w END WHEN {ends('ing')} THEN CASE WHEN {vowel(3)} THEN {cut(3)} || '+' ELSE w END ELSE w END",
        # + marks a word that lost ed or ing
        f"CASE WHEN NOT {ends('+')} THEN w WHEN {ends('at+')} OR {ends('bl+')} OR {ends('iz+')} THEN {cut(1, 'e')} WHEN len(w) > 2 AND substr(w, len(w) - 1, 1) = substr(w, len(w) - 2, 1) AND substr(s, len(s) - 1, 1) = 'C' THEN CASE WHEN substr(w, len(w) - 1, 1) IN ('l', 's', 'z') THEN CASE WHEN {m(1)} = 1 AND {cvc(1)} THEN {cut(1, 'e')} ELSE {cut(1)} END ELSE {cut(2)} END WHEN {m(1)} = 1 AND {cvc(1)} THEN {cut(1, 'e')} ELSE {cut(1)} END",
        f"CASE WHEN {ends('y')} AND {vowel(1)} THEN {cut(1, 'i')} ELSE w END",
        table(stem.STEP2, 0), table(stem.STEP3, 0), table(dict.fromkeys(stem.STEP4, ""), 1, "substr(w, len(w) - 3, 1) IN ('s', 't')"),
        f"CASE WHEN {ends('e')} AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {cvc(1)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {m(0)} > 1 THEN {cut(1)} ELSE w END",
    ]
    out = [f"p0 AS (SELECT word, lower(word) AS w, {shape('lower(word)')} AS s FROM {words} WHERE regexp_full_match(word, '[A-Za-z]{{3,32}}'))"]
    out += [f"p{i} AS (SELECT word, w, {shape('w')} AS s FROM (SELECT word, {x} AS w FROM p{i - 1}))" for i, x in enumerate(steps, 1)]
    return ", ".join([*out, f"stems AS (SELECT word, 'porter:' || w AS stem FROM p{len(steps)} UNION ALL SELECT word, word FROM {words} WHERE NOT regexp_full_match(word, '[A-Za-z]{{3,32}}'))"])


query("stem_vocab", f"WITH {TERMS}, voc AS (SELECT DISTINCT term AS word FROM term), {_porter('voc')} SELECT word, stem FROM stems")(lambda s, d: stem.stem_vocabulary(S.words(texts(s, d).docs).select(F.explode("words").alias("word"))))
_STOPPED = f"left_ AS (SELECT * FROM topic WHERE term NOT IN ({', '.join(repr(x) for x in R.STOPWORDS)})), qs AS (SELECT * FROM left_ UNION ALL SELECT * FROM topic WHERE topic NOT IN (SELECT topic FROM left_))"
query(
    "pipeline_stop_stem",
    f"""WITH {TF}, {TOPIC}, {_STOPPED}, voc AS (SELECT term AS word FROM term UNION SELECT term FROM topic), {_porter('voc')}, x AS (SELECT topic, stem AS term, count(*)::DOUBLE AS w FROM qs JOIN stems ON word = qs.term GROUP BY ALL),
    stf AS (SELECT doc, stem AS term, sum(tf.tf) AS tf FROM tf JOIN stems ON word = tf.term WHERE stem IN (SELECT term FROM x) GROUP BY ALL), sdf AS (SELECT term, count(*) AS df FROM stf GROUP BY term),
    s2 AS (SELECT topic, doc, round(sum(x.w * ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (0.9::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * len / avgl) + tf)), 6) AS score
    FROM x JOIN stf USING (term) JOIN sdf USING (term) JOIN item USING (doc), tot WHERE ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 GROUP BY topic, doc) SELECT topic, doc, score, {_RANK} FROM s2 WHERE score > 0 QUALIFY rank <= 1000""",
)(lambda s, d: R.pipeline(documents(s, d).index, benchmark_topics(s, d), "stop stem k1=0.9 bm25"))
_TRIALS = R.random_params("bm25", 4)


@query(
    "tune_trials",
    f"""WITH {TF}, {TOPIC}, pr AS (SELECT * FROM (VALUES {", ".join(f"({i}, {p['b']!r}::DOUBLE, {p['k1']!r}::DOUBLE)" for i, p in enumerate(_TRIALS))}) v(trial, b, k1)),
    s AS (SELECT trial, topic, doc, round(sum(ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (k1 * ((1 - b) + b * len / avgl) + tf)), 6) AS score FROM topic JOIN tf USING (term) JOIN df USING (term) JOIN item USING (doc), tot, pr
        WHERE ln((items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 GROUP BY trial, topic, doc),
    r AS (SELECT *, row_number() OVER (PARTITION BY trial, topic ORDER BY score DESC, doc) AS rank FROM s WHERE score > 0 QUALIFY rank <= 100), g AS (SELECT doc_id AS doc, max(quality) AS gain FROM labels GROUP BY 1)
    SELECT topic, trial, round(0.05 * sum(coalesce(gain, 0) * pow(0.95, rank - 1)), 6) AS value FROM r LEFT JOIN g USING (doc) GROUP BY topic, trial""",
)
def tune_trials(s, d):
    """RBP of BM25 for random parameters, topic by topic; documents of quality 1 are relevant to every topic."""
    run = R.bm25_trials(documents(s, d).index, benchmark_topics(s, d), _TRIALS, depth=100)
    gain = table(s, d, "labels").groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").cast("double").alias("gain"))
    judged = run.join(gain, "doc", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    return _round(judged.groupBy("topic", "trial").agg((0.05 * F.sum(F.col("gain") * F.pow(F.lit(0.95), F.col("rank") - 1))).alias("value")))


def _orders_trials(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("trial")).agg(F.avg("o_totalprice").alias("value"))


query(
    "tune_bootstrap",
    f"""WITH t AS (SELECT o_orderpriority AS topic, year(o_orderdate) AS trial, avg(o_totalprice) AS value FROM orders GROUP BY ALL), n AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS k FROM (SELECT DISTINCT topic FROM t)),
    dr AS (SELECT round, CAST(floor({_UNIFORM.format("'1:' || round || ':' || k")} * (SELECT count(*) FROM n)) AS BIGINT) AS pick FROM n, range(1, 1001) r(round)),
    m AS (SELECT round, trial, round(avg(value), 12) AS value FROM dr JOIN n ON n.k = pick JOIN t USING (topic) GROUP BY ALL), b AS (SELECT round, trial FROM m QUALIFY row_number() OVER (PARTITION BY round ORDER BY value DESC, trial) = 1) SELECT CAST(trial AS INTEGER) AS trial, count(*) AS wins FROM b GROUP BY trial""",
)(lambda s, d: E.bootstrap(_orders_trials(s, d)))

# --- the index, cursors and windows

query("idx_postings", f"WITH {TOK} SELECT doc, count(*) AS tf, string_agg(pos, ' ' ORDER BY pos) AS positions FROM tok WHERE lower(word) = '{A}' GROUP BY doc")(lambda s, d: documents(s, d).index.rows([A]).select("doc", F.size("positions").cast("long").alias("tf"), F.array_join("positions", " ").alias("positions")))
query("idx_terms", f"WITH {TF}, n AS (SELECT lower(word) AS feature, count(*) AS count FROM tok GROUP BY 1) SELECT feature, coalesce(df, 0) AS df, count FROM n LEFT JOIN df ON term = feature")(lambda s, d: documents(s, d).index.terms().where(F.col("feature") == F.lower("feature")).select("feature", "df", "count"))
query("gcl_optimized", f"{AB}, {LINES}, {reduced('r', 'SELECT doc, least(a.p, b.p, c.p) AS p, greatest(a.q, b.q, c.q) AS q FROM a JOIN b USING (doc) JOIN c USING (doc)')} SELECT doc, p, q FROM r WHERE EXISTS (SELECT 1 FROM line WHERE line.doc = r.doc AND line.p <= r.p AND r.q <= line.q)")(
    lambda s, d: spans(with_lines(s, d).gcl(f"(<< (^ {A} {B} {C3}) line:)"))
)
query("gcl_windows", f"WITH {WORDS} SELECT doc_id AS doc, unnest(range(0, len(ws) - 2)) AS p, p + 2 AS q FROM (SELECT doc AS doc_id, ws FROM w WHERE len(ws) BETWEEN 3 AND 60)")(lambda s, d: spans(_short(s, d).gcl("(# 3)")))
query("gcl_empty", f"{AB} SELECT doc, p, q FROM a WHERE false")(lambda s, d: spans(documents(s, d).gcl(f"(^ {A} nosuchwordanywhere)")))
query("gcl_singleton", "SELECT doc_id AS doc, 2::BIGINT AS p, 5::BIGINT AS q FROM documents WHERE doc_id = 7")(lambda s, d: spans(texts(s, d).annotate(_one(s)).gcl("only:")))
for _f, _sym, _cond in (("not_within", "!<", "q - p + 1 > 5"), ("at_least", ">>", "q - p + 1 >= 5"), ("below", "!>", "q - p + 1 < 5")):
    query(f"gcl_width_{_f}", f"{AB}, {reduced('r', AND_SRC)} SELECT * FROM r WHERE {_cond}")(lambda s, d, x=_sym: spans(documents(s, d).gcl(f"({x} (^ {A} {B}) (# 5))")))
for _m, _which in (("l", "q <= line.q"), ("r", "p >= line.p")):
    # L(k): the last interval that ends at or before k; R(k): the first that begins at or after k
    query(f"cursor_{_m}", f"{AB}, {reduced('r', AND_SRC)}, {LINES}, k AS (SELECT DISTINCT doc, {'q' if _m == 'l' else 'p'} AS k FROM line) SELECT k.doc, k.k, {'max' if _m == 'l' else 'min'}(r.p) AS p, {'max' if _m == 'l' else 'min'}(r.q) AS q FROM k LEFT JOIN r ON r.doc = k.doc AND r.{_which.replace('line.p', 'k.k').replace('line.q', 'k.k')} GROUP BY k.doc, k.k")(
        lambda s, d, m=_m: I.probe(documents(s, d).gcl(f"(^ {A} {B})"), documents(s, d).lines().select("doc", F.col("q" if m == "l" else "p").alias("k")).distinct(), {"l": "uat", "r": "tau"}[m]).select("doc", "k", "p", "q")
    )
query("stat_df_difference", f"WITH {TF}, u AS (SELECT item_id AS doc, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM benchmark), v AS (SELECT CASE WHEN regexp_matches(substr(word, 2), '[A-Z]') THEN word ELSE lower(word) END AS term, count(DISTINCT doc) AS two FROM u GROUP BY 1) SELECT term, coalesce(df, 0) AS one, two FROM v LEFT JOIN df USING (term) WHERE coalesce(df, 0) <> two")(
    lambda s, d: S.df_difference(_benchmark(s, d).select("term"), documents(s, d).index, S.Stats(Collection.of(table(s, d, "benchmark"), "item_id", "text").docs))
)


def _benchmark(s, d) -> DataFrame:
    return S.df(Collection.of(table(s, d, "benchmark"), "item_id", "text").docs)


def _short(s, d) -> Collection:
    c = texts(s, d)
    return Collection(c.docs.join(c.lengths().where("length between 3 and 60"), "doc").select("doc", "text"))


def _one(s) -> DataFrame:
    return s.createDataFrame([("only:", 7, 2, 5, 0.0, None)], "feature string, doc long, p long, q long, v double, n long")


# --- sources


@query("src_jsonl", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, len(text) AS chars, 1::BIGINT AS sources FROM conversations")
def src_jsonl(s, d):
    """conversations written as JSON lines, read again and taken apart: a record's values by path, and its source as a feature."""
    path = shared.new_path(s, "jsonl")
    table(s, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.text(path)
    rows = readers.json_annotations(s, path)
    at = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    per = rows.groupBy("id").agg(at(":conv_id:").cast("long").alias("conv_id"), at(":turn:").cast("long").alias("turn"), at(":role:").alias("role"), F.length(at(":text:")).cast("long").alias("chars"), F.sum((F.col("kind") == "source").cast("long")).alias("sources"))
    return per.drop("id")


@query("src_files", "SELECT CAST(page_id AS BIGINT) AS page, len(coalesce(html, '')) + 1 AS chars FROM pages WHERE page_id < 20")
def src_files(s, d):
    """A file tree: each file's name and content as annotated parts of one document."""
    path = shared.new_path(s, "tree")
    pages = table(s, d, "pages").where("page_id < 20")
    pages.select("page_id", F.coalesce("html", F.lit("")).alias("value")).repartition("page_id").write.partitionBy("page_id").text(path)
    c = loaders.file_tree(s, f"{path}/*/*.txt")
    name = c.translate(c.term("filename:")).select("doc", F.regexp_extract("content", r"page_id=(\d+)", 1).cast("long").alias("page"))
    inside = c.gcl("(<< content: file:)").select("doc")
    size = c.docs.join(inside, "doc").select("doc", (F.length("text") - F.length(F.element_at(F.split("text", "\n", 2), 1)) - 1).cast("long").alias("chars"))
    return name.join(size, "doc").select("page", "chars")


@query("src_passages", r"SELECT 'MARCO_' || item_id AS docno, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS words FROM benchmark")
def src_passages(s, d):
    """A passage collection in separated lines: :pid and :paragraph."""
    path = shared.new_path(s, "passages")
    table(s, d, "benchmark").select(F.concat_ws("\t", "item_id", F.regexp_replace("text", r"[\t\r\n]", " ")).alias("value")).write.text(path)
    c = loaders.marco_lines(s, path)
    pid = c.translate(c.term(":pid")).select("doc", T.docno(F.col("content")).alias("docno"), F.col("q").alias("last"))
    return pid.join(c.term(":paragraph").select("doc", "q"), "doc").select("docno", (F.col("q") - F.col("last")).alias("words"))


@query("src_web_records", "SELECT page_id, url, len(regexp_extract_all(html, '[A-Za-z0-9]+')) AS words FROM pages WHERE len(regexp_extract_all(html, '[A-Za-z0-9]+')) > 0")
def src_web_records(s, d):
    """Web records of text and url in JSON lines: :text, :url and the whole; pages find theirs by both, for urls repeat."""
    path = shared.new_path(s, "records")
    pages = table(s, d, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("text"))
    pages.select(F.to_json(F.struct("text", F.coalesce("url", F.lit("")).alias("url"))).alias("value")).write.text(path)
    c = loaders.web_records(s, path)
    url = c.translate(c.gcl("(<< :url :)")).select("doc", T.docno(F.col("content")).alias("tail"))
    words = c.term(":text").select("doc", (F.col("q") - F.col("p") + 1).alias("words"))
    own = loaders.web_docs(pages.select("page_id", F.col("url").alias("said"), F.coalesce("url", F.lit("")).alias("url"), "text"))
    own = own.select("doc", "page_id", F.col("said").alias("url"), T.docno(F.regexp_extract("url", "(?s)[A-Za-z0-9].*", 0)).alias("own"))
    found = words.join(url, "doc", "left").join(own, "doc").where(F.coalesce("tail", F.lit("")) == F.col("own"))
    return found.select("page_id", "url", "words")


@query("docno_join", "SELECT source || '-' || doc_id AS docno, doc_id AS doc, (pow(2, quality) - 1) / pow(2, (SELECT greatest(max(quality), 1) FROM labels)) AS gain FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL")
def docno_join(s, d):
    """Judgements by document number find their documents through the numbers that stand in the texts."""
    docs = table(s, d, "documents").where("source is not null")
    c = loaders.of_parts(docs.select(F.col("doc_id").alias("doc"), F.array(loaders.part(":pid", F.concat_ws("-", "source", "doc_id")), loaders.part("", F.coalesce("text", F.lit("")))).alias("parts")), [":paragraph"])
    qrels = table(s, d, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.lit("all").alias("topic"), F.concat(F.lit("<DOCNO> "), "source", F.lit("-"), "doc_id", F.lit(" </DOCNO>")).alias("docno"), F.col("quality").alias("grade"))
    return E.located(E.gains(qrels), c, ":pid").select("docno", "doc", "gain")


@query("json_date_forms", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS created FROM orders")
def json_date_forms(s, d):
    """Dates in the five textual forms of the sample collections, one order each in turn."""
    o, day = table(s, d, "orders"), F.col("o_orderdate").cast("timestamp")
    forms = [F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000-0700")), F.date_format(day, "MMM d yyyy"), (F.unix_timestamp(F.date_trunc("day", day)) * 1000).cast("string"), F.date_format(day, "EEE MMM dd HH:mm:ss 'UTC' yyyy"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T20:02:24.386Z"))]
    kind = F.pmod(F.col("o_orderkey"), F.lit(5))
    said = F.coalesce(*[F.when(kind == i, f) for i, f in enumerate(forms)])
    date = T.textual_date(said)
    return o.select("o_orderkey", F.year(date).cast("long").alias("y"), F.month(date).cast("long").alias("m"), F.dayofmonth(date).cast("long").alias("d"), F.unix_timestamp(date.cast("timestamp")).alias("created"))


query("json_markers", r"""SELECT event_id, regexp_replace(regexp_replace(props, '[{}:,]', '', 'g'), '"', '', 'g') AS words FROM events""")(lambda s, d: table(s, d, "events").select("event_id", F.regexp_replace(F.regexp_replace(J.mark(F.col("props")), J.STRUCTURE, ""), '"', "").alias("words")))

# --- the store and the service


def _two_sources(s, d) -> versioned.Store:
    st = versioned.Store(s, shared.new_path(s, "store"))
    st.begin().append(texts(s, d).docs).commit()
    return st


@query("dyn_forage_once", f"WITH {TOK}, {LINES} SELECT 'tf-idf' AS name, 'ln' AS tag, (SELECT count(*) FROM (SELECT DISTINCT l.doc, l.p, lower(word) FROM line l JOIN tok ON tok.doc = l.doc AND pos BETWEEN l.p AND l.q)) + (SELECT count(DISTINCT lower(word)) FROM tok) AS annotations")
def dyn_forage_once(s, d):
    """A forager's run is recorded with it; a second run of the same name and tag does nothing."""
    st = _two_sources(s, d)
    c = texts(s, d)
    st.begin().annotate(c.lines()).commit()
    for _ in range(2):
        versioned.forage_once(st, "line:", "tf-idf", "ln")
    snap = st.snapshot()
    n = snap.annotations().where(F.col("feature").startswith("ln:")).agg(F.count("*").alias("annotations"))
    return snap.foragers().select("name", "tag").crossJoin(F.broadcast(n))  # one row


@query("dyn_index", f"WITH {TOK} SELECT doc, pos AS p, pos AS q FROM tok WHERE lower(word) = '{A}' AND doc NOT BETWEEN 10 AND 40")
def dyn_index(s, d):
    """Postings stored for a version of the store, without what was erased before."""
    st = _two_sources(s, d)
    st.begin().erase(10, 40).commit()
    return spans(st.snapshot().collection(index=True).term(A))


@query("dyn_recover", "SELECT doc_id AS doc, length(coalesce(text, '')) AS chars FROM documents")
def dyn_recover(s, d):
    """A writer that died between its claim and its version, and data that no version names, are taken back."""
    st = _two_sources(s, d)
    dead = st.begin().append(texts(s, d).docs.limit(1))
    st._fs.create(st._p(f"versions/{2:012d}.claim"), False).close()  # claimed, never published
    st.sanitize(older_than=0)
    assert not st._fs.exists(st._p(dead.files[0][1]))
    st.begin().erase(-5, -5).commit()
    return st.snapshot().docs().select("doc", F.length("text").cast("long").alias("chars"))


@query("dyn_policy", "SELECT doc_id AS doc, length(coalesce(text, '')) AS chars FROM documents")
def dyn_policy(s, d):
    """Many small commits are merged by size, step by step, until none is left to merge."""
    st = versioned.Store(s, shared.new_path(s, "store"))
    docs = texts(s, d).docs
    for k in range(4):
        st.begin().append(docs.where(F.pmod("doc", F.lit(4)) == k)).commit()
    st.compact_by_policy()
    assert len([f for f in st.manifest()["files"] if f[0] == "docs"]) == 1
    return st.snapshot().docs().select("doc", F.length("text").cast("long").alias("chars"))


@query("service_next", f"{AB}, {reduced('r', AND_SRC)}, s AS ({_BEST}) SELECT 'docs' AS collection, doc, score, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank BETWEEN 6 AND 10")
def service_next(s, d):
    """The second page of five of a search over two collections, of which one has no hits."""
    empty = Collection(s.createDataFrame([(0, "nothing here")], "doc long, text string"))
    search = Service({"docs": documents(s, d), "none": empty})
    qid = search.query(f"(^ {A} {B})", gcl=True)
    search.next(qid, 5)
    return search.page(qid, 5, 5).select("collection", "doc", "score", "rank")


query("service_document", "SELECT doc_id AS doc, text FROM documents WHERE doc_id = 17")(lambda s, d: Service({"docs": documents(s, d)}).documents("docs", [17]))
