"""Text, search, linking, gate and evidence queries, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import LIGATURES, QUESTION_WORDS, STOPWORDS, TYPOGRAPHY
from ..operators import evidence as E
from ..operators import gate as gating
from ..operators import linking, search
from .binding import Tables, sql
from .catalogue import register


def _fold_sql(c: str) -> str:
    for a, b in (*LIGATURES, *TYPOGRAPHY):
        a, b = a.replace("'", "''"), b.replace("'", "''")
        c = f"replace({c}, '{a}', '{b}')"
    return f"translate({c}, '{T.ACCENTED}', '{T.PLAIN}')"


_IN = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@register("normalize_name", f"SELECT item_id, trim(regexp_replace(lower({_fold_sql('text')}), '\\s+', ' ', 'g')) AS name FROM benchmark")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).t("benchmark").select("item_id", T.normalize_name(F.col("text")).alias("name"))


@register("normalize_any_name", f"SELECT doc_id, md5(trim(regexp_replace(lower({_fold_sql('text')}), '\\s+', ' ', 'g'))) AS name FROM documents")
def normalize_any_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents folded by the decomposition for any script; the tables' languages have Latin letters alone, so the other fold must agree."""
    return Tables(spark, sf_dir).t("documents").select("doc_id", F.md5(T.normalize_any(F.col("text"))).alias("name"))


@register("loose_name", f"SELECT item_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({_fold_sql('text')}), '\\s+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g'), '\\s+', ' ', 'g')) AS name FROM benchmark")
def loose_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).t("benchmark").select("item_id", T.loose_name(F.col("text")).alias("name"))


@register("split_faces", "SELECT p_partkey, trim(p_name) AS face_0, trim(p_type) AS face_1, 2 AS n_faces FROM part")
def split_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = T.split_faces(F.concat("p_name", F.lit(" // "), "p_type"))
    df = Tables(spark, sf_dir).t("part").select("p_partkey", faces.alias("f"))
    return df.select("p_partkey", F.get("f", F.lit(0)).alias("face_0"), F.get("f", F.lit(1)).alias("face_1"), F.size("f").alias("n_faces"))


@register("symbol_value", "SELECT p_partkey, 'X|' || p_size || '|W/2|G' AS symbols, CAST(p_size + 3 AS DOUBLE) AS value FROM part")
def symbol_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Tables(spark, sf_dir).t("part").withColumn("cost", F.format_string("{X}{%d}{W/2}{G}", "p_size"))
    return df.select("p_partkey", F.array_join(T.parse_symbols(F.col("cost")), "|").alias("symbols"), T.symbol_value(F.col("cost")).alias("value"))


@register("stable_id_sha256", "SELECT o_orderkey, substr(sha256(o_orderkey || '|' || coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '')), 1, 32) AS id FROM orders")
def stable_id_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).t("orders").select("o_orderkey", T.stable_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"))


@register("explicit_citations", r"SELECT doc_id, number FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b([0-9]{3}\.[0-9]+[a-z]?)\b', 1)) AS number FROM documents)")
def explicit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).t("documents").select("doc_id", F.explode(T.explicit_citations(F.col("text"))).alias("number"))


@register("extract_references", "SELECT p_partkey, CAST(100 + p_size AS VARCHAR) || '.' || p_size || ',' || CAST(200 + p_size AS VARCHAR) || '.1a' AS refs FROM part")
def extract_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("See rules %d.%d and %d.1a, and again rule %d.%d; not 999.9.", F.col("p_size") + 100, "p_size", F.col("p_size") + 200, F.col("p_size") + 100, "p_size")
    return Tables(spark, sf_dir).t("part").select("p_partkey", F.array_join(T.extract_references(said), ",").alias("refs"))


_TERM = (
    "CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN substr(t, 1, length(t) - 3) || 'y' WHEN regexp_matches(t, '(ses|xes|zes|ches|shes)$') AND length(t) > 4 THEN substr(t, 1, length(t) - 2) "
    "WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN substr(t, 1, length(t) - 1) ELSE t END"
)


def _terms_sql(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, {_TERM} AS term FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '([a-z][a-z'']+)', 1)) AS t FROM {table}) WHERE length(t) > 2 AND t NOT IN ({_IN(STOPWORDS)})"


_IDX = f"idx AS ({_terms_sql('documents', 'doc_id')}), idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM idx GROUP BY 1)"


@register("tfidf_idf", f"WITH {_IDX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).t("documents")
    return search.inverse_frequencies(search.postings(docs, "doc_id", "text"), "doc_id", docs.count()).withColumn("idf", F.round("idf", 6))


_HITS = f"{_IDX}, q AS ({_terms_sql('benchmark', 'item_id')}), h AS (SELECT item_id AS question_id, doc_id, round(CAST(sum(CAST(idf AS DECIMAL(20, 9))) AS DOUBLE), 6) AS score FROM q JOIN idf USING (term) JOIN idx USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM h)"


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    questions = t.t("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return search.search(t.t("documents").select("doc_id", "text"), "doc_id", "text", questions, 8)


@register("tfidf_topk", f"WITH {_HITS} SELECT question_id, doc_id, score, rank FROM r WHERE rank <= 8")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)


@register("search_significant", f"WITH {_HITS} SELECT question_id, doc_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS top FROM r WHERE rank <= 8) WHERE score >= 0.6 * top")
def search_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.significant(_search(spark, sf_dir), 0.6)


_SENT = r"list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+([\"''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"


@register("sentence_segments", f"SELECT conv_id, turn, len(s) AS n_sentences, s[1] AS first_sentence FROM (SELECT conv_id, turn, {_SENT} AS s FROM conversations WHERE role = 'assistant')")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).t("conversations").where("role = 'assistant'").withColumn("s", T.split_sentences(F.col("text")))
    return c.select("conv_id", "turn", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@register("citation_markers", "SELECT o_orderkey, 'rule:' || o_custkey || ',ruling:1' AS handles, 'See it. Done.' AS plain FROM orders")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("See  it [rule:%d; ruling:1] . Done [ruling:1].", "o_custkey")
    return Tables(spark, sf_dir).t("orders").select("o_orderkey", F.array_join(T.citation_handles(said), ",").alias("handles"), T.strip_citations(said).alias("plain"))


@register("question_terms", f"SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE text END AS terms FROM (SELECT conv_id, turn, text, list_filter(regexp_extract_all(text, '([A-Za-z][A-Za-z''-]+)', 1), lambda x: lower(x) NOT IN ({_IN(QUESTION_WORDS)})) AS w FROM conversations WHERE role = 'user')")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).t("conversations").where("role = 'user'")
    return c.select("conv_id", "turn", T.question_terms(F.col("text")).alias("terms"))


@register("token_estimate", "SELECT lang, count(*) AS n, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@register("rule_numbers", "SELECT p_partkey, CAST(100 + p_size AS VARCHAR) || '.4' AS parent, 3 AS level, CAST(100 + p_size AS VARCHAR) || '.4' AS family FROM part")
def rule_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.format_string("%d.4b", F.col("p_size") + 100)
    return Tables(spark, sf_dir).t("part").select("p_partkey", T.parent_number(n).alias("parent"), T.level_of(n).alias("level"), T.rule_family(n).alias("family"))


# --- linking ----------------------------------------------------------------------------------------------------


@register(
    "mention_scan",
    "WITH lx AS (SELECT item_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 5), ' ') AS surface FROM benchmark), "
    "d AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), g AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS surface FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)) "
    "SELECT doc_id, item_id, i AS start_word FROM g JOIN lx USING (surface)",
)
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    words = F.split(T.collapse_spaces(F.col("text")), " ")
    lexicon = t.t("benchmark").select("item_id", F.array_join(F.slice(words, 1, 5), " ").alias("surface"))
    return linking.ngram_mentions(t.t("documents").select("doc_id", "text"), lexicon, "doc_id", "item_id", 5)


# --- gate -------------------------------------------------------------------------------------------------------

_CAND = (
    "cand AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CAST(l_orderkey AS VARCHAR) AS source_key, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_partkey + CASE WHEN l_suppkey % 7 = 0 THEN 100000000 ELSE 0 END AS VARCHAR) END AS target_key, "
    "round(1.0 - l_discount * 4, 2) AS confidence, l_linenumber % 5 AS k FROM lineitem)"
)
_JUDGED = (
    f"{_CAND}, src AS (SELECT CAST(o_orderkey AS VARCHAR) AS source_key, o_orderpriority AS text FROM orders WHERE o_orderkey % 13 <> 0), j AS (SELECT c.*, CASE WHEN k = 4 THEN 'schema_invalid' WHEN s.source_key IS NULL THEN 'source_not_in_graph' WHEN k = 3 THEN 'span_not_verbatim' "
    "WHEN target_key IS NULL THEN 'mention_unresolved' WHEN p_partkey IS NULL THEN 'card_not_in_graph' WHEN confidence < 0.7 THEN 'low_confidence' END AS reason FROM cand c LEFT JOIN src s USING (source_key) LEFT JOIN part ON target_key = CAST(p_partkey AS VARCHAR)), "
    "g AS (SELECT source_key, target_key, ord, confidence, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, source_key, target_key ORDER BY confidence DESC, ord) > 1 THEN 'duplicate' ELSE reason END AS reason FROM j)"
)


def _gated(spark: SparkSession, sf_dir: str) -> gating.GatedFrame:
    t = Tables(spark, sf_dir)
    orders = t.t("orders").select(F.col("o_orderkey").cast("string").alias("source_key"), F.col("o_orderpriority").alias("text"))
    line = t.t("lineitem").withColumn("source_key", F.col("l_orderkey").cast("string")).join(orders, "source_key", "left")
    target = F.col("l_partkey") + F.when(F.col("l_suppkey") % 7 == 0, 100_000_000).otherwise(0)
    k = F.col("l_linenumber") % 5
    candidates = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(k == 4, "ELSE").otherwise("MENTIONS").alias("edge_type"), "source_key",
        F.when(F.col("l_suppkey") % 11 != 0, target.cast("string")).alias("target_key"), F.lit(0).alias("span_start"), F.length("text").alias("span_end"),
        F.when(k == 3, F.concat(F.lit("not "), "text")).otherwise(F.col("text")).alias("span_text"), F.lit("exact").alias("method"), F.round(1.0 - F.col("l_discount") * 4, 2).alias("confidence"),
    )
    return gating.gate(candidates, orders.where("cast(source_key as bigint) % 13 <> 0"), t.rules(), t.cards())


@register("gate_accept", f"WITH {_JUDGED} SELECT source_key, target_key, max(confidence) AS confidence, count(*) AS n FROM g WHERE reason IS NULL GROUP BY 1, 2")
def gate_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).accepted().groupBy("source_key", "target_key").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


@register("gate_reject_counts", f"WITH {_JUDGED} SELECT reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY 1")
def gate_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).reject_counts()


# --- evidence ---------------------------------------------------------------------------------------------------

_EV = (
    "ev AS (SELECT user_id AS question_id, event_id AS arrival, CASE event_type WHEN 'click' THEN 'rule' WHEN 'view' THEN 'ruling' ELSE 'card' END AS kind, CAST(event_id % 37 AS VARCHAR) AS key, repeat('x', CAST(10 + event_id % 90 AS INT)) AS text, "
    "CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS template, CAST(event_id % 4 AS INT) AS distance FROM events)"
)
_CAPPED = f"{_EV}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, template, kind, key ORDER BY arrival) AS rn FROM ev) WHERE rn = 1), cp AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY question_id, template, kind ORDER BY arrival) AS rn FROM d) WHERE rn <= 5)"


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).t("events")
    kind = F.when(F.col("event_type") == "click", "rule").when(F.col("event_type") == "view", "ruling").otherwise("card")
    return e.select(
        F.col("user_id").alias("question_id"), F.col("event_id").alias("arrival"), kind.alias("kind"), (F.col("event_id") % 37).cast("string").alias("key"),
        F.expr("repeat('x', cast(10 + event_id % 90 as int))").alias("text"), F.when(F.col("event_id") % 3 == 0, "a").otherwise("b").alias("template"),
        F.lit("p").alias("path"), (F.col("event_id") % 4).cast("int").alias("distance"),
    )


@register("evidence_cap", f"WITH {_CAPPED} SELECT question_id, template, kind, key, arrival FROM cp")
def evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cap(evidence_rows(spark, sf_dir), 5).select("question_id", "template", "kind", "key", "arrival")


@register("evidence_capped_counts", f"WITH {_CAPPED} SELECT question_id, kind, count(*) AS capped FROM ev e WHERE NOT EXISTS (SELECT 1 FROM cp c WHERE c.question_id = e.question_id AND c.template = e.template AND c.kind = e.kind AND c.key = e.key) GROUP BY 1, 2")
def evidence_capped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.capped_counts(evidence_rows(spark, sf_dir), 5)


_BUDGET = f"{_CAPPED}, tk AS (SELECT *, greatest(1, length(text) // 4) AS tokens FROM cp), bd AS (SELECT *, sum(tokens) OVER (PARTITION BY question_id) - coalesce(sum(tokens) OVER (PARTITION BY question_id ORDER BY distance DESC, arrival DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM tk)"


@register("evidence_budget", f"WITH {_BUDGET} SELECT question_id, arrival, CAST(tokens AS BIGINT) AS tokens FROM bd WHERE remaining <= 200")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.budget(E.cap(evidence_rows(spark, sf_dir), 5), 200).select("question_id", "arrival", "tokens")


@register(
    "ruling_handles",
    f"WITH {_EV}, n AS (SELECT question_id, arrival, CASE WHEN kind = 'ruling' THEN 'ruling:' || row_number() OVER (PARTITION BY question_id, kind = 'ruling' ORDER BY arrival) ELSE kind || ':' || key END AS handle FROM ev) SELECT question_id, handle, min(arrival) AS arrival FROM n GROUP BY 1, 2",
)
def ruling_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.handles(evidence_rows(spark, sf_dir)).select("question_id", "handle", "arrival")


@register("evidence_fingerprint", f"WITH {_EV} SELECT question_id, sha256(string_agg(kind || '|' || key || '|' || text || '|' || template || '|p|' || distance, chr(10) ORDER BY arrival)) AS sha256 FROM ev GROUP BY 1")
def evidence_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fingerprint(evidence_rows(spark, sf_dir))


@register(
    "serialize_subgraph",
    f"WITH {_EV}, n AS (SELECT *, CASE WHEN kind = 'ruling' THEN 'ruling:' || row_number() OVER (PARTITION BY question_id, kind = 'ruling' ORDER BY arrival) ELSE kind || ':' || key END AS handle FROM ev), f AS (SELECT question_id, handle, arg_min(kind, arrival) AS kind, arg_min(text, arrival) AS text, arg_min(template, arrival) AS template, min(arrival) AS arrival FROM n GROUP BY 1, 2), "
    "k AS (SELECT question_id, CASE kind WHEN 'card' THEN 1 WHEN 'rule' THEN 3 ELSE 4 END AS rank, '## ' || kind || chr(10) || string_agg('[' || handle || '] ' || text || chr(10) || '    via ' || template || ': p', chr(10) ORDER BY arrival) AS said FROM f GROUP BY question_id, kind), "
    "l AS (SELECT question_id, count(*) AS n FROM ev WHERE arrival % 5 = 0 GROUP BY 1) "
    "SELECT question_id, string_agg(said, chr(10) ORDER BY rank, said) || coalesce(any_value(chr(10) || chr(10) || 'NOTICE: ' || n || ' further items did not fit here; name the gap where an answer rests on them.'), '') AS body FROM k LEFT JOIN l USING (question_id) GROUP BY 1",
)
def serialize_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_rows(spark, sf_dir)
    return E.serialize(rows, rows.where("arrival % 5 = 0").groupBy("question_id").agg(F.count(F.lit(1)).alias("n")))


@register("retrieve_evidence", sql("card_keywords defined_by rules", ", e AS (SELECT card_id AS question_id, keyword AS key, number FROM card_keywords JOIN defined_by USING (keyword)) SELECT question_id, 'keyword' AS kind, key, number || '/' || key AS path FROM e UNION ALL SELECT DISTINCT question_id, 'rule', number, number FROM e"))
def retrieve_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and rule evidence of every card, through the emit mapping."""
    t = Tables(spark, sf_dir)
    rows = t.card_keywords().join(t.defined_by(), "keyword").withColumn("row_no", F.xxhash64("keyword")).withColumnRenamed("card_id", "question_id")
    emits = [
        {"kind": "keyword", "key": "keyword", "text": "keyword", "path": "concat(number, '/', keyword)"},
        {"kind": "rule", "key": "number", "text": "number", "path": "number", "distance": 1},
    ]
    return E.dedupe(E.emit(rows, "card_keyword_rules", emits)).select("question_id", "kind", "key", "path")
