"""Seeds, reachability, generated questions and set hashes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as U
from ..operators import evaluation as V
from ..operators import generators as N
from ..operators import graph as G
from ..operators import reach as R
from ..operators.cuts import cut
from .binding import Tables, sql
from .catalogue import register
from .retrieval_queries import _K, knowledge


def _entities(t: Tables, k) -> DataFrame:
    """(question_id, name): a question for each part names its card, some a keyword in capitals, some a thing that isn't there."""
    p = t.t("part").select(F.col("p_partkey").alias("question_id"), F.col("p_partkey").cast("string").alias("card_id"), "p_type", "p_size")
    own = p.join(k.cards, "card_id").select("question_id", "name")
    words = p.where("p_size < 10").select("question_id", F.concat("p_type", F.lit("WALK")).alias("name"))
    return own.unionByName(words).unionByName(p.where("p_size > 45").select("question_id", F.lit("Nobody").alias("name")))


_ENT = "ent AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN 'card_with_kw' ELSE 'card_no_kw' END AS how, CASE WHEN p_size % 5 <> 0 THEN lower(p_type) || 'walk' END AS keyword FROM part UNION ALL SELECT p_partkey, 'keyword', lower(p_type) || 'walk' FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'unknown', NULL FROM part WHERE p_size > 45) "


@register("seed_classes", sql("hosts rulings mentions cites refs legal", ", " + _K + _ENT + "SELECT h AS how, count(id) AS n FROM (SELECT unnest(['keyword', 'card_with_kw', 'card_no_kw', 'unknown']) AS h) LEFT JOIN ent ON how = h GROUP BY 1"))
def seed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k = knowledge(t)
    return R.class_counts(R.resolved_entities(_entities(t, k), k.defined_by, k.cards, k.card_keywords))


@register(
    "reachability_report",
    sql(
        "hosts rulings mentions cites refs legal",
        ", " + _K + _ENT + ", sd AS (SELECT DISTINCT id, number FROM ent JOIN kd USING (keyword)), e AS (SELECT src, dst FROM kref UNION SELECT dst, src FROM kref UNION SELECT parent, number FROM kr WHERE parent IS NOT NULL UNION SELECT number, parent FROM kr WHERE parent IS NOT NULL), "
        "b1 AS (SELECT number AS seed, number AS node FROM (SELECT DISTINCT number FROM sd) UNION SELECT number, dst FROM (SELECT DISTINCT number FROM sd) JOIN e ON src = number), b2 AS (SELECT seed, node FROM b1 UNION SELECT seed, dst FROM b1 JOIN e ON src = node), "
        "rch AS (SELECT DISTINCT id, node FROM sd JOIN b2 ON seed = number), sz AS (SELECT id, count(*) AS size FROM rch GROUP BY 1), gold AS (SELECT p_partkey AS id, number FROM part JOIN kn ON n_nationkey = p_partkey % 25 UNION SELECT p_partkey, number || 'b' FROM part JOIN kn ON n_nationkey = p_partkey % 25), "
        "ht AS (SELECT gold.id, count(node) AS hit, count(*) AS total FROM gold LEFT JOIN rch ON rch.id = gold.id AND node = number GROUP BY 1), "
        "j AS (SELECT p_type AS stratum, coalesce(size, 0) AS size, hit, total, sz.id IS NULL AS bare, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(size, 0)) - 1 AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM part LEFT JOIN sz ON sz.id = p_partkey JOIN ht ON ht.id = p_partkey) "
        "SELECT stratum, max(n) AS n, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(total) AS BIGINT) AS total, count(*) FILTER (WHERE bare) AS no_seed, max(CASE WHEN rn = n // 2 THEN size END) AS median_ball FROM j GROUP BY 1",
    ),
)
def reachability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rules within two hops of each question's seeds, by the part's type; questions without a seed are among them."""
    t = Tables(spark, sf_dir)
    k = knowledge(t)
    seeds = cut(R.seed_rules(R.resolved_entities(_entities(t, k), k.defined_by, k.cards, k.card_keywords), k.defined_by, k.card_keywords))
    part = t.t("part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("stratum"), (F.col("p_partkey") % 25).cast("int").alias("n_nationkey"))
    number = F.format_string("10%d.%d", "n_regionkey", "n_nationkey")
    gold = part.join(F.broadcast(t.t("nation")), "n_nationkey").select("question_id", F.explode(F.array(number, F.concat(number, F.lit("b")))).alias("number"))
    tree = k.rules.where("parent is not null").select(F.col("parent").alias("src"), F.col("number").alias("dst"))
    return R.reachability(part, gold, seeds, cut(G.undirected(k.references, tree)), 2)


@register(
    "definition_questions",
    sql("hosts rulings mentions cites refs legal", ", " + _K.rstrip(", ") + " SELECT 'define-' || keyword AS id, 'What does ' || keyword || ' do?' AS question, text AS answer, number AS rules, 'keyword ' || keyword || ' > rule ' || number AS gold_path, sha256(keyword || '|' || number || '|' || text) AS snapshot_sha256 FROM kt JOIN kd USING (keyword)"),
)
def definition_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = knowledge(Tables(spark, sf_dir))
    made = N.definition_questions(k.keywords.join(k.defined_by, "keyword").select("keyword", "number", F.col("text").alias("answer")), k.rules)
    return made.select("id", "question", "answer", F.array_join("gold_cr_rules", ",").alias("rules"), "gold_path", "snapshot_sha256")


_ANSWERS = {"legal": "Yes, {name} is legal in {format}.", "banned": "No, {format} bans {name}.", "restricted": "One copy of {name} in {format}."}


@register(
    "legality_questions",
    sql(
        "cards legal",
        "SELECT 'legal-' || card_id || '-' || format AS id, 'Is ' || name || ' legal in ' || format || '?' AS question, CASE status WHEN 'legal' THEN 'Yes, ' || name || ' is legal in ' || format || '.' WHEN 'banned' THEN 'No, ' || format || ' bans ' || name || '.' ELSE 'One copy of ' || name || ' in ' || format || '.' END AS answer, "
        "'card ' || card_id || ' > ' || status || ' in ' || format AS gold_path, sha256(card_id || '|' || format || '|' || status) AS snapshot_sha256 FROM cards JOIN legal USING (card_id) WHERE status <> 'not_legal'",
    ),
)
def legality_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return N.legality_questions(t.cards(), t.legalities(), _ANSWERS).select("id", "question", "answer", "gold_path", "snapshot_sha256")


@register("frozen_set_hash", "SELECT lang, sha256(string_agg(doc_id || '|' || coalesce(quality, ''), chr(10) ORDER BY doc_id || '|' || coalesce(quality, ''))) AS sha256 FROM (SELECT lang, doc_id, CAST(max(quality) AS VARCHAR) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2) GROUP BY 1")
def frozen_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that freezes a set of labels, here a language's: its lines in order, whatever the order of the rows; a frozen set is one file of labels."""
    t = Tables(spark, sf_dir)
    rows = t.t("labels").join(t.t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "doc_id").agg(F.max("quality").alias("quality"))
    return rows.groupBy("lang").agg(V.set_hash(F.col("doc_id"), F.coalesce(F.col("quality").cast("string"), F.lit(""))).alias("sha256"))


@register(
    "sufficiency_reopened",
    "WITH l AS (SELECT o_orderkey AS question_id, CASE o_orderstatus WHEN 'F' THEN 'sufficient' WHEN 'O' THEN 'partial' END AS label, o_orderpriority LIKE '1%' AS again, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) "
    "SELECT again, CASE WHEN NOT again THEN label END AS label, CASE WHEN NOT again THEN label END AS stale_label, count(*) AS n, CAST(sum(coalesce(n, 0)) AS BIGINT) AS evidence FROM l GROUP BY ALL",
)
def sufficiency_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all orders as questions, begun with their lines as evidence, labelled by status, and reopened for one priority."""
    t = Tables(spark, sf_dir)
    o = t.t("orders").select(F.col("o_orderkey").alias("question_id"), F.lit("resolved").alias("outcome"), "o_orderstatus", "o_orderpriority")
    counts = t.t("lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.count(F.lit(1)).alias("kept"))
    status = F.when(F.col("o_orderstatus") == "F", "sufficient").when(F.col("o_orderstatus") == "O", "partial")
    labels = U.sufficiency_init(o, counts).drop("label").join(o.select("question_id", status.alias("label")), "question_id")
    out = U.sufficiency_reopen(labels, o.where("o_orderpriority like '1%'").select("question_id"), o.where("o_orderpriority like '2%'").select("question_id"))
    again = F.col("o_orderpriority").startswith("1").alias("again")
    return out.join(o.select("question_id", again), "question_id").groupBy("again", "label", "stale_label").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("evidence"))
