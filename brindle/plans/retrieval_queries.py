"""Retrieval from question to bounded evidence, one question for each part: cards, legality, rules, pairs, keywords, and questions that name nothing, nothing sure or nothing known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import QUESTION_WORDS
from ..operators import linking as L
from ..operators import retrieval as R
from .binding import Tables, sql
from .catalogue import register
from .text_queries import _IN, _terms_sql

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CAP, BUDGET = 8, 150


def knowledge(t: Tables) -> R.Knowledge:
    """Parts as cards with their type's keyword (but for each fifth size), nations as rules with a subrule for each market segment, orders as rulings."""
    part, nation = t.t("part"), F.broadcast(t.t("nation"))
    segment = F.get(F.array(*[F.lit(s) for s in _SEGMENTS]), (F.col("p_partkey") % 5).cast("int"))
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" "), F.col("p_partkey").cast("string"))
    cards = part.select(F.col("p_partkey").cast("string").alias("card_id"), name.alias("name"), F.concat("p_type", F.lit(" part of the "), segment, F.lit(" trade")).alias("text"), "p_partkey")
    keyword = F.concat(F.lower("p_type"), F.lit("walk"))
    own = part.where("p_size % 5 <> 0").select(F.col("p_partkey").cast("string").alias("card_id"), keyword.alias("keyword"))
    keywords = part.select(keyword.alias("keyword"), F.concat("p_type", F.lit(" parts walk")).alias("text")).distinct()
    number = F.format_string("10%d.%d", "n_regionkey", "n_nationkey")
    place = F.col("n_regionkey") * 1_000_000 + F.col("n_nationkey") * 100
    defined = keywords.select("keyword", ((F.ascii("keyword") + 7 * F.length("keyword")) % 25).cast("int").alias("n_nationkey")).join(nation, "n_nationkey").select("keyword", number.alias("number"))
    chapters = t.t("region").select(F.format_string("10%d", "r_regionkey").alias("number"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), F.col("r_name").alias("text"), (F.col("r_regionkey") * 1_000_000 - 1).cast("long").alias("pos"))
    rules = nation.select(number.alias("number"), F.format_string("10%d", "n_regionkey").alias("parent"), F.lit(2).alias("level"), F.concat(F.lit("Trade with "), "n_name").alias("text"), place.cast("long").alias("pos"))
    sold = t.t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")).join(nation, "n_nationkey")
    letter = F.array_position(F.array(*[F.lit(s) for s in _SEGMENTS]), F.col("segment"))
    subs = sold.where(letter > 0).select(
        F.concat(number, F.substring(F.lit("abcde"), letter.cast("int"), F.lit(1))).alias("number"), number.alias("parent"), F.lit(3).alias("level"),
        F.concat("segment", F.lit(" customers of "), "n_name", F.lit(": "), F.col("n").cast("string")).alias("text"), (place + letter).cast("long").alias("pos"),
    )
    renumbered = lambda c: F.concat(F.lit("10"), F.expr(f"substring({c}, 2)")).alias(c)
    as_key = F.col("card_id").cast("string").alias("card_id")
    return R.Knowledge(
        cards=cards.drop("p_partkey"), card_keywords=own, keywords=keywords, defined_by=defined,
        legalities=t.legalities().select(as_key, F.concat(F.lit("Format "), "format").alias("format"), "status"),
        rulings=t.rulings().select("ruling_id", as_key, "text", "published_at"), cites=t.cites().select("ruling_id", renumbered("number")), mentions=t.mentions().select("ruling_id", as_key),
        rules=chapters.unionByName(rules).unionByName(subs), references=t.references().select(renumbered("src"), renumbered("dst")),
        formats=t.legalities().select(F.concat(F.lit("Format "), "format").alias("name")).distinct(), lexicon=L.lexicon(cards.select("name", F.col("card_id").alias("id"))),
    )


def questions(t: Tables, k: R.Knowledge) -> DataFrame:
    """(question_id, question): eight kinds of questions, by the part's number."""
    host = t.rulings().select("ruling_id", F.col("card_id").alias("host"))
    other = t.mentions().join(host, "ruling_id").groupBy(F.col("host").cast("string").alias("card_id")).agg(F.min("card_id").cast("string").alias("with"))
    q = k.cards.select("card_id", "name").join(other, "card_id", "left").withColumn("with", F.coalesce("with", F.lit("0")))
    q = q.join(k.cards.select(F.col("card_id").alias("with"), F.col("name").alias("with_name")), "with")
    part, nation = t.t("part"), F.broadcast(t.t("nation"))
    q = q.join(part.select(F.col("p_partkey").cast("string").alias("card_id"), "p_partkey", "p_type", (F.col("p_partkey") % 25).cast("int").alias("n_nationkey")), "card_id").join(nation, "n_nationkey")
    flag = F.get(F.array(*[F.lit(x) for x in "ANR"]), (F.col("p_partkey") % 3).cast("int"))
    kinds = [
        F.concat(F.lit("How does "), "name", F.lit(" work?")),
        F.concat(F.lit("what about "), F.lower("name"), F.lit("?")),
        F.lit("Why is that so?"),
        F.concat(F.lit("Is "), "name", F.lit(" legal in Format "), flag, F.lit("?")),
        F.format_string("Explain rule 10%d.%d please.", "n_regionkey", "n_nationkey"),
        F.concat(F.lit("Does "), "name", F.lit(" affect "), "with_name", F.lit("?")),
        F.concat(F.lit("What does "), F.initcap("p_type"), F.lit("walk mean?")),
        F.lit("Explain rule 999.9 please."),
    ]
    said = F.get(F.array(*kinds), (F.col("p_partkey") % 8).cast("int"))
    return q.select(F.col("p_partkey").alias("question_id"), said.alias("question"))


def numbered_cards(k: R.Knowledge):
    """A last resort: the card whose number ends a question, where the number is even."""

    def run(failed: DataFrame) -> DataFrame:
        asked = failed.select("question_id", F.regexp_extract("question", r"[a-z] ([0-9]*[02468])\?$", 1).alias("card_id")).where("card_id <> ''")
        path = F.concat(F.lit("number "), "card_id").alias("path")
        return asked.join(k.cards, "card_id").select("question_id", F.lit(1).alias("item_no"), F.lit("card").alias("kind"), F.col("name").alias("key"), "text", path, F.lit(1).alias("distance"))

    return run


_K = (
    "seg AS (SELECT * FROM (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD'), (4, 'MACHINERY')) s(i, segment)), "
    "kc AS (SELECT p_partkey AS card_id, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || p_partkey AS name, p_type || ' part of the ' || segment || ' trade' AS text FROM part JOIN seg ON i = p_partkey % 5), "
    "kk AS (SELECT p_partkey AS card_id, lower(p_type) || 'walk' AS keyword FROM part WHERE p_size % 5 <> 0), kt AS (SELECT DISTINCT lower(p_type) || 'walk' AS keyword, p_type || ' parts walk' AS text FROM part), "
    "kn AS (SELECT n.*, '10' || n_regionkey || '.' || n_nationkey AS number FROM nation n), kd AS (SELECT keyword, number FROM kt JOIN kn ON n_nationkey = (ascii(keyword) + 7 * length(keyword)) % 25), "
    "kr AS (SELECT '10' || r_regionkey AS number, CAST(NULL AS VARCHAR) AS parent, 1 AS level, r_name AS text, r_regionkey * 1000000 - 1 AS pos FROM region UNION ALL SELECT number, '10' || n_regionkey, 2, 'Trade with ' || n_name, n_regionkey * 1000000 + n_nationkey * 100 FROM kn "
    "UNION ALL SELECT number || substr('abcde', i + 1, 1), number, 3, segment || ' customers of ' || n_name || ': ' || n, n_regionkey * 1000000 + n_nationkey * 100 + i + 1 FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) JOIN kn ON n_nationkey = c_nationkey JOIN seg ON segment = c_mktsegment), "
    "sub AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY pos) AS item FROM (SELECT parent AS root, number, text, pos FROM kr WHERE parent IS NOT NULL UNION ALL SELECT a.parent, b.number, b.text, b.pos FROM kr a JOIN kr b ON b.parent = a.number WHERE a.parent IS NOT NULL)), "
    "kl AS (SELECT card_id, 'Format ' || format AS format, status FROM legal), kref AS (SELECT '10' || substr(src, 2) AS src, '10' || substr(dst, 2) AS dst FROM refs), kcite AS (SELECT ruling_id, '10' || substr(number, 2) AS number FROM cites), "
    "prs AS (SELECT r.card_id, min(m.card_id) AS other FROM rulings r JOIN mentions m USING (ruling_id) GROUP BY 1), "
    "q AS (SELECT p_partkey AS id, p_partkey % 8 AS kind, p_partkey AS a, coalesce(other, 0) AS b, 'Format ' || substr('ANR', CAST(p_partkey % 3 + 1 AS INT), 1) AS fmt, number, lower(p_type) || 'walk' AS kw FROM part LEFT JOIN prs ON card_id = p_partkey JOIN kn ON n_nationkey = p_partkey % 25), "
    "ask AS (SELECT id, 0 AS base, a AS card_id FROM q WHERE kind IN (0, 3, 5) UNION ALL SELECT id, 3, b FROM q WHERE kind = 5 AND b <> a), "
    "rl AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY published_at DESC, ruling_id) AS rn FROM rulings), "
    "kws AS (SELECT id, base + 2 AS call, 1 AS row, keyword, 1 AS d, 'card > keyword ' AS lead, 'card_keyword_rules' AS template FROM ask JOIN kk USING (card_id) UNION ALL SELECT id, 1, 0, kw, 0, 'keyword ', 'keyword_definition' FROM q WHERE kind = 6), "
    "men AS (SELECT r.card_id AS a, m.card_id AS b, ruling_id, text, row_number() OVER (PARTITION BY r.card_id, m.card_id ORDER BY ruling_id) AS item FROM rulings r JOIN mentions m USING (ruling_id)), "
    "bare AS (SELECT id, card_id FROM ask WHERE id NOT IN (SELECT id FROM ask JOIN kk USING (card_id)) AND id % 8 <> 3), "
)
_TEXT = (
    "asked AS (SELECT DISTINCT q.id AS question_id, CASE WHEN q.kind = 0 THEN 'How does ' || x.name || ' work?' ELSE 'Does ' || x.name || ' affect ' || y.name || '?' END AS question, "
    "(SELECT string_agg(text, ' ') FROM bare b JOIN kc USING (card_id) WHERE b.id = q.id) AS more FROM q JOIN kc x ON x.card_id = q.a JOIN kc y ON y.card_id = q.b WHERE q.id IN (SELECT id FROM bare)), "
    f"topics AS (SELECT question_id, array_to_string(CASE WHEN len(w) > 0 THEN w ELSE [question] END, ' ') || ' ' || more AS text FROM (SELECT *, list_filter(regexp_extract_all(question, '([A-Za-z][A-Za-z''-]+)', 1), lambda x: lower(x) NOT IN ({_IN(QUESTION_WORDS)})) AS w FROM asked)), "
    f"corpus AS (SELECT number, text FROM kr WHERE level > 1), idx AS ({_terms_sql('corpus', 'number')}), idf AS (SELECT term, CAST(round(ln((SELECT count(*) FROM corpus) / count(*)), 9) AS DECIMAL(20, 9)) AS idf FROM idx GROUP BY 1), tq AS ({_terms_sql('topics', 'question_id')}), "
    "hs AS (SELECT question_id AS id, number, round(CAST(sum(idf) AS DOUBLE), 6) AS score FROM tq JOIN idf USING (term) JOIN idx USING (term) GROUP BY 1, 2), hr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, number) AS item, max(score) OVER (PARTITION BY id) AS top FROM hs), "
)
_EVIDENCE = (
    "ev AS (SELECT id, base + 1 AS call, 0 AS row, 0 AS emit, 0 AS item, 'card' AS kind, name AS key, text, 'card ' || name AS path, 0 AS distance, 'card_core' AS template FROM ask JOIN kc USING (card_id) "
    "UNION ALL SELECT id, call, row, 0, 0, 'keyword', keyword, text, lead || keyword, d, template FROM kws JOIN kt USING (keyword) "
    "UNION ALL SELECT id, call, row, 1, 0, 'rule', number, text, 'keyword ' || keyword || ' > rule ' || number, d + 1, template FROM kws JOIN kd USING (keyword) JOIN kr USING (number) "
    "UNION ALL SELECT id, call, row, 2, item, 'rule', sub.number, text, 'rule ' || root || ' > below', d + 2, template FROM kws JOIN kd USING (keyword) JOIN sub ON root = kd.number "
    "UNION ALL SELECT id, base + 3, rn, 0, 0, 'ruling', CAST(ruling_id AS VARCHAR), rl.text, 'card ' || name || ' > ruling', 1, 'card_rulings' FROM ask JOIN rl USING (card_id) JOIN kc USING (card_id) WHERE rn <= 50 "
    "UNION ALL SELECT id, base + 3, rn, 1, 1, 'rule', number, kr.text, 'ruling > cites', 2, 'card_rulings' FROM ask JOIN rl USING (card_id) JOIN kcite USING (ruling_id) JOIN kr USING (number) WHERE rn <= 50 "
    "UNION ALL SELECT id, 4, 0, 0, 0, 'legality', format, status, 'card ' || name || ' > ' || status || ' in ' || format, 0, 'card_legality' FROM q JOIN kl ON card_id = a AND format = fmt JOIN kc USING (card_id) WHERE kind = 3 "
    "UNION ALL SELECT id, 1, 0, 0, 0, 'rule', number, text, 'rule ' || number, 0, 'rule_subtree' FROM q JOIN kr USING (number) WHERE kind = 4 UNION ALL SELECT id, 1, 0, 1, item, 'rule', sub.number, text, 'rule ' || root || ' > below', 1, 'rule_subtree' FROM q JOIN sub ON root = q.number WHERE kind = 4 "
    "UNION ALL SELECT id, 2, 0, 0, 0, 'rule', number, text, 'rule ' || number, 0, 'rule_neighbourhood' FROM q JOIN kr USING (number) WHERE kind = 4 "
    "UNION ALL SELECT id, 2, 0, 1, pos, 'rule', dst, text, 'rule ' || src || ' > refers to', 1, 'rule_neighbourhood' FROM q JOIN kref ON src = q.number JOIN kr ON kr.number = dst WHERE kind = 4 "
    "UNION ALL SELECT id, 2, 0, 2, pos, 'rule', src, text, 'rule ' || dst || ' < refers to', 1, 'rule_neighbourhood' FROM q JOIN kref ON dst = q.number JOIN kr ON kr.number = src WHERE kind = 4 "
    "UNION ALL SELECT id, 7, 0, e, item, 'ruling', CAST(ruling_id AS VARCHAR), men.text, 'card ' || x.name || ' > ruling > mentions card ' || y.name, 1, 'card_interaction' FROM (SELECT id, a, b, 0 AS e FROM q WHERE kind = 5 AND a <> b UNION ALL SELECT id, b, a, 1 FROM q WHERE kind = 5 AND a <> b) p JOIN men USING (a, b) JOIN kc x ON x.card_id = a JOIN kc y ON y.card_id = b "
    "UNION ALL SELECT id, 7, 0, 2, 1, 'rule', kd.number, kd.keyword, 'card ' || x.name || ' > keyword < card ' || y.name, 2, 'card_interaction' FROM q JOIN kk k1 ON k1.card_id = a JOIN kk k2 ON k2.card_id = b AND k2.keyword = k1.keyword JOIN kd ON kd.keyword = k1.keyword JOIN kc x ON x.card_id = a JOIN kc y ON y.card_id = b WHERE q.kind = 5 AND a <> b "
    "UNION ALL SELECT id, 1048576, 0, 0, item, 'rule', hr.number, substr(kr.text, 1, 160), 'words shared with the question, score ' || printf('%.1f', score), 1, 'text_search' FROM hr JOIN kr USING (number) WHERE item <= 8 AND score >= 0.25 * top "
    "UNION ALL SELECT id, 0, 0, 0, 1, 'card', name, text, 'number ' || id, 1, 'last_resort' FROM q JOIN kc ON card_id = id WHERE kind = 1 AND id % 2 = 0), "
    "arr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY call, row, emit, item, key) AS arrival, greatest(1, length(text) // 4) AS tokens FROM ev), "
    "ded AS (SELECT * FROM arr QUALIFY row_number() OVER (PARTITION BY id, template, kind, key ORDER BY arrival) = 1), "
    f"cap AS (SELECT * FROM ded QUALIFY row_number() OVER (PARTITION BY id, template, kind ORDER BY arrival) <= {CAP}), "
    f"kept AS (SELECT * FROM cap QUALIFY sum(tokens) OVER (PARTITION BY id) - coalesce(sum(tokens) OVER (PARTITION BY id ORDER BY distance DESC, arrival DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {BUDGET}) "
)


def _retrieved(spark: SparkSession, sf_dir: str) -> R.Retrieval:
    t = Tables(spark, sf_dir)
    k = knowledge(t)
    return R.retrieve(questions(t, k), k, CAP, BUDGET, last_resort=numbered_cards(k))


@register(
    "retrieve_batch",
    sql(
        "hosts rulings mentions cites refs legal",
        ", " + _K + _TEXT + _EVIDENCE + ", dig AS (SELECT id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, md5(string_agg(kind || '|' || key || '|' || text || '|' || template || '|' || path || '|' || distance, chr(10) ORDER BY arrival)) AS evidence FROM kept GROUP BY 1) "
        "SELECT q.id AS question_id, CASE WHEN n IS NOT NULL THEN 'resolved' WHEN kind = 1 THEN 'ambiguous' WHEN kind = 2 THEN 'no_entities' ELSE 'no_match' END AS outcome, "
        "CASE WHEN kind IN (4, 6, 7) THEN 'graph' WHEN kind = 3 THEN 'legality' WHEN kind IN (0, 5) THEN CASE WHEN q.id IN (SELECT id FROM bare) THEN 'text_search' ELSE 'graph' END END AS route, "
        "kind = 1 AND q.id % 2 = 0 AS fallback, coalesce(n, 0) AS n, coalesce(tokens, 0) AS tokens, coalesce(evidence, md5('')) AS evidence FROM q LEFT JOIN dig USING (id)",
    ),
)
def retrieve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, route and evidence of each question; the evidence as a digest of its rows in order, which a cap and a budget bound."""
    got = _retrieved(spark, sf_dir)
    line = F.concat_ws("|", "kind", "key", "text", "template", "path", F.col("distance").cast("string"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("arrival", line.alias("line")))), lambda x: x["line"])
    digest = got.evidence.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.md5(F.array_join(rows, "\n")).alias("evidence"))
    out = got.outcomes.join(digest, "question_id", "left")
    return out.select("question_id", "outcome", "route", "fallback", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("evidence", F.md5(F.lit(""))).alias("evidence"))
