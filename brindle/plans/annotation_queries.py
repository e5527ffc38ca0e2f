"""Annotation, migration and generator queries, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import graph as G
from ..operators import migration
from .binding import Tables, sql
from .catalogue import register


@register("annotation_update", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'revised' ELSE o_orderstatus END AS status, o_orderpriority AS prio FROM orders")
def annotation_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"))
    edits = rows.where("k % 3 = 0").select("k", F.lit("revised").alias("status"), F.lit(None).cast("string").alias("prio"))
    return A.apply_keyed(rows, edits, "k")


@register("annotation_unmatched", "SELECT c_custkey AS k, 'row' AS side FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT DISTINCT o_custkey, 'edit' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def annotation_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return A.unmatched(t.t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("k")), t.t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k")


@register("pass_comparison", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality AS first, b.toxic AS second, a.quality IS NOT DISTINCT FROM b.toxic AS agree FROM (SELECT * FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT * FROM labels WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id")
def pass_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = Tables(spark, sf_dir).t("labels")
    a = labels.where("doc_id % 5 <> 0").select("doc_id", F.col("quality").alias("v"))
    return A.compare_passes(a, labels.where("doc_id % 7 <> 0").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@register("span_check", "SELECT doc_id, substr(text, 6, 8) AS surface, true AS right, length(text) >= 6 AND false AS wrong FROM documents WHERE length(text) >= 14")
def span_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).t("documents").where("length(text) >= 14").select("doc_id", "text", F.substring("text", 6, 8).alias("surface"))
    at = lambda a, b, s: A.verbatim(F.col("text"), F.lit(a), F.lit(b), s)
    return d.select("doc_id", "surface", at(5, 13, F.col("surface")).alias("right"), at(5, 13, F.concat("surface", F.lit("!"))).alias("wrong"))


@register("marked_spans", "SELECT item_id, substr(text, 1, 3) || '>>' || substr(text, 4, 4) || '<<' || substr(text, 8, 2) || '>>' || substr(text, 10, 3) || '<<' || substr(text, 13) AS marked FROM benchmark")
def marked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.array(pair(9, 12), pair(3, 7))
    return Tables(spark, sf_dir).t("benchmark").select("item_id", A.mark_spans(F.col("text"), spans).alias("marked"))


@register("vocabulary_overlap", "SELECT source AS item, count(DISTINCT lang) AS groups FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vocabulary_overlap(Tables(spark, sf_dir).t("documents").select("lang", F.col("source").alias("item")), "lang", "item")


@register("answer_segments", "SELECT o_orderkey, s AS sentence, c AS cited, h AS handles FROM (SELECT o_orderkey, 'First one.' AS s, true AS c, 'rule:' || o_custkey AS h FROM orders UNION ALL SELECT o_orderkey, 'Then 2.5 more.', false, '' FROM orders UNION ALL SELECT o_orderkey, 'Last?', true, 'ruling:1,card:x' FROM orders)")
def answer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("First one. [rule:%d] Then 2.5 more. Last [ruling:1; card:x]?", "o_custkey")
    s = Tables(spark, sf_dir).t("orders").select("o_orderkey", F.explode(A.segment_answer(said)).alias("s"))
    return s.select("o_orderkey", "s.sentence", "s.cited", F.array_join("s.handles", ",").alias("handles"))


@register("expanded_citations", "SELECT o_orderkey AS question_id, 'rule:' || o_custkey AS handle, '[path: C' || o_custkey || ']' AS shown, true AS known FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 'rule:' || o_custkey, '[UNVERIFIED rule:' || o_custkey || ']', false FROM orders WHERE o_custkey % 2 <> 0")
def expanded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).t("orders")
    answers = o.select(F.col("o_orderkey").alias("question_id"), F.format_string("See [rule:%d].", "o_custkey").alias("answer"))
    evidence = o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("question_id"), F.format_string("rule:%d", "o_custkey").alias("handle"), F.format_string("C%d", "o_custkey").alias("path"))
    return A.expand_citations(answers, evidence)


@register("generated_questions", sql("cards legal", "SELECT card_id || ':' || format AS id, 'Is ' || name || ' legal in ' || format || '?' AS question, CASE status WHEN 'legal' THEN 'Yes' WHEN 'restricted' THEN 'Yes, one copy' ELSE 'No' END AS answer FROM cards JOIN legal USING (card_id)"))
def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.cards().join(t.legalities(), "card_id")
    said = F.when(F.col("status") == "legal", "Yes").when(F.col("status") == "restricted", "Yes, one copy").otherwise("No")
    return rows.select(F.concat_ws(":", "card_id", "format").alias("id"), F.format_string("Is %s legal in %s?", "name", "format").alias("question"), said.alias("answer"))


@register("candidate_rules", sql("card_keywords defined_by rules", "SELECT keyword, number, rn FROM (SELECT d.keyword, r.number, row_number() OVER (PARTITION BY d.keyword ORDER BY r.number) AS rn FROM defined_by d JOIN rules r ON r.parent = d.number) WHERE rn <= 7"))
def candidate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven subrules of each keyword's rule."""
    t = Tables(spark, sf_dir)
    sub = t.defined_by().join(t.rules().select(F.col("parent"), F.col("number").alias("sub")), F.col("number") == F.col("parent"))
    return G.numbered(sub, ["keyword"], ["sub"]).where("rn <= 7").select("keyword", F.col("sub").alias("number"), "rn")


@register("seed_resolution", sql("cards card_keywords", "SELECT CASE WHEN k.keyword IS NOT NULL THEN 'keyword' WHEN c.name IS NOT NULL THEN 'card' ELSE 'none' END AS how, count(*) AS n FROM (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN (SELECT min(keyword) FROM card_keywords) WHEN event_id % 3 = 1 THEN (SELECT min(normalized_name) FROM cards) ELSE event_type END AS said FROM events) LEFT JOIN (SELECT DISTINCT keyword FROM card_keywords) k ON k.keyword = said LEFT JOIN (SELECT DISTINCT normalized_name AS name FROM cards) c ON c.name = said GROUP BY 1"))
def seed_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    kw, names = t.card_keywords().select("keyword").distinct(), t.cards().select(F.col("normalized_name").alias("name")).distinct()
    first, card = kw.agg(F.min("keyword").alias("k")).scalar(), names.agg(F.min("name").alias("c")).scalar()
    said = F.when(F.col("event_id") % 3 == 0, first).when(F.col("event_id") % 3 == 1, card).otherwise(F.col("event_type"))
    rows = t.t("events").select(said.alias("said"))
    out = rows.join(kw, F.col("said") == F.col("keyword"), "left").join(names, F.col("said") == F.col("name"), "left")
    how = F.when(F.col("keyword").isNotNull(), "keyword").when(F.col("name").isNotNull(), "card").otherwise("none")
    return out.groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("n"))


_NUMBERED = "(100 + item_id // 10) || '.' || item_id % 10"


@register(
    "migration_verdicts",
    f"SELECT {_NUMBERED} AS number, CASE item_id % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'edited' WHEN 2 THEN 'relocated' ELSE 'orphaned' END AS verdict, CASE item_id % 4 WHEN 2 THEN (101 + item_id // 10) || '.' || item_id % 10 || 'b' WHEN 3 THEN NULL ELSE {_NUMBERED} END AS target, "
    "CASE item_id % 4 WHEN 1 THEN round(2.0 * length(t) / (2 * length(t) + 4), 6) WHEN 2 THEN 1.0 END::DOUBLE AS ratio FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)",
)
def migration_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a numbered text of which some got a word more, moved by a chapter or were dropped; what becomes of each follows from its number."""
    b = Tables(spark, sf_dir).t("benchmark").select("item_id", "text")
    number = lambda k: F.format_string("%d.%d", F.lit(100) + (k / 10).cast("int"), k % 10)
    old = b.select(number(F.col("item_id")).alias("number"), "text", "item_id")
    edited = F.when(F.col("item_id") % 4 == 1, F.concat("text", F.lit(" now"))).otherwise(F.col("text"))
    moved = F.when(F.col("item_id") % 4 == 2, F.col("item_id") + 10).otherwise(F.col("item_id"))
    new = old.where("item_id % 4 <> 3").withColumn("text", edited).withColumn("number", F.concat(number(moved), F.when(F.col("item_id") % 4 == 2, "b").otherwise("")))
    return migration.judge(old.select("number", "text"), new.select("number", "text"))
