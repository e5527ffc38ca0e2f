"""Answer and audit queries over conversations, documents and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import audits as U
from ..operators import graph as G
from ..operators.cuts import cut
from .binding import Tables, sql
from .catalogue import register
from .retrieval_queries import _K, knowledge
from .text_queries import _terms_sql


@register(
    "answers_written_out",
    "WITH a AS (SELECT conv_id * 1000 + turn AS id, text, conv_id % 7 AS k, turn FROM conversations WHERE role = 'assistant'), "
    "e AS (SELECT id, k, '[CR ' || k || ']' AS r, CASE WHEN turn % 2 = 0 THEN '[ruling R' || id || ']' END AS g FROM a) "
    "SELECT a.id AS question_id, text || ' ' || CASE WHEN turn % 2 = 0 THEN '[path: by ' || a.k || '; of ' || a.k || '] ' || r || ' ' || g ELSE '[path: by ' || a.k || '] ' || r || ' [UNVERIFIED ruling:1]' END || '. So [UNVERIFIED x:' || a.k || '] ends ' || '[path: by ' || a.k || '] ' || r || '.' AS text, "
    "CASE WHEN turn % 2 = 0 THEN 'x:' || a.k ELSE 'ruling:1,x:' || a.k END AS unknown FROM a JOIN e USING (id)",
)
def answers_written_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn with markers after it: rules with their paths, rulings on even turns alone, and a handle that nobody gave."""
    c = Tables(spark, sf_dir).t("conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text", (F.col("conv_id") % 7).cast("string").alias("k"), "turn")
    answer = F.concat("text", F.lit(" [rule:"), "k", F.lit("; ruling:1]. So [x:"), "k", F.lit("] ends [rule:"), "k", F.lit("]."))
    rules = c.select("question_id", F.concat(F.lit("rule:"), "k").alias("handle"), F.lit("rule").alias("kind"), F.col("k").alias("key"), F.concat(F.lit("by "), "k").alias("path"))
    rulings = c.where("turn % 2 = 0").select("question_id", F.lit("ruling:1").alias("handle"), F.lit("ruling").alias("kind"), F.concat(F.lit("R"), F.col("question_id").cast("string")).alias("key"), F.concat(F.lit("of "), "k").alias("path"))
    return A.written_out(c.select("question_id", answer.alias("answer")), rules.unionByName(rulings)).withColumn("unknown", F.array_join("unknown", ","))


_ITEM = "(100 + item_id // 10) || '.' || item_id % 10"


@register(
    "citation_findings",
    f"WITH rule AS (SELECT {_ITEM} AS number, text FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT doc_id, (100 + (doc_id % n) // 10) || '.' || (doc_id % n) % 10 AS number, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS n FROM documents, n UNION ALL SELECT doc_id, '100', 1 FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, '999.1', 1 FROM documents WHERE lang = 'es'), "
    f"dt AS ({_terms_sql('documents', 'doc_id')}), rt AS ({_terms_sql('rule', 'number')}), s AS (SELECT DISTINCT c.doc_id, c.number FROM c JOIN dt USING (doc_id) JOIN rt ON rt.number = c.number AND rt.term = dt.term) "
    "SELECT doc_id AS ruling_id, number, 'duplicate' AS \"check\", 'error' AS severity, CAST(n AS BIGINT) AS n FROM c WHERE n > 1 UNION ALL SELECT doc_id, number, 'chapter-level', 'error', n FROM c WHERE number = '100' UNION ALL SELECT doc_id, number, 'unresolvable', 'error', n FROM c WHERE number = '999.1' "
    "UNION ALL SELECT doc_id, number, 'no-shared-vocabulary', 'review', n FROM c WHERE number NOT IN ('100', '999.1') AND doc_id IN (SELECT doc_id FROM dt) AND (doc_id, number) NOT IN (SELECT doc_id, number FROM s)",
)
def citation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rulings that cite benchmark items, some twice, some a chapter, some a rule that isn't there."""
    t = Tables(spark, sf_dir)
    number = lambda k: F.format_string("%d.%d", F.lit(100) + (k / 10).cast("int"), k % 10)
    docs, items = t.t("documents"), t.t("benchmark")
    n = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = docs.select(F.col("doc_id").alias("ruling_id"), number(F.col("doc_id") % n).alias("number"))
    cited = base.unionByName(base.where("ruling_id % 5 = 0")).unionByName(docs.where("source = 'src1'").select(F.col("doc_id").alias("ruling_id"), F.lit("100").alias("number"))).unionByName(docs.where("lang = 'es'").select(F.col("doc_id").alias("ruling_id"), F.lit("999.1").alias("number")))
    return U.findings(cited, docs.select(F.col("doc_id").alias("ruling_id"), "text"), items.select(number(F.col("item_id")).alias("number"), "text"))


@register(
    "citation_changes",
    "WITH c AS (SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS text, l_tax > 0.04 AS old, l_quantity > 25 AS quote FROM lineitem) SELECT count(*) AS entries, count(*) FILTER (WHERE text OR old OR NOT quote) AS changed, count(*) FILTER (WHERE text) AS texts_dropped FROM c",
)
def citation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as nested citations: numbers under an older name, places without a quote, texts of rules."""
    line, none = Tables(spark, sf_dir).t("lineitem"), F.lit(None).cast("string")
    number, old = F.col("l_partkey").cast("string"), F.col("l_tax") > 0.04
    entry = F.struct(
        F.when(~old, number).alias("rule_number"), F.when(old, number).alias("rule"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + 5).cast("int").alias("end"),
        F.when(F.col("l_quantity") > 25, F.lit("quote")).otherwise(none).alias("quote"), F.when(F.col("l_discount") > 0.05, F.lit("rule text")).alias("text"),
    )
    return U.citation_changes(line.groupBy("l_orderkey").agg(F.collect_list(entry).alias("cited_rules")), "cited_rules")


@register(
    "ruling_prompts",
    sql(
        "hosts rulings mentions cites refs legal",
        ", " + _K + "one AS (SELECT card_id AS owner, d.number AS root FROM kk JOIN kd d USING (keyword)), heads AS (SELECT number AS root, number, text, 0 AS item FROM kr UNION ALL SELECT root, number, text, item FROM sub WHERE item <= 2), "
        "cand AS (SELECT owner, item, heads.number, substr(text, 1, 20) AS snippet FROM one JOIN heads USING (root)), c AS (SELECT owner, string_agg('- ' || number || ': ' || snippet, chr(10) ORDER BY item) AS said FROM cand GROUP BY 1) "
        "SELECT ruling_id, CASE WHEN said IS NULL THEN '' ELSE 'Rules that may govern it (cite others only if you know that they exist):' || chr(10) || said || chr(10) || chr(10) END || 'Ruling: \"' || text || '\"' AS prompt FROM rulings LEFT JOIN c ON owner = card_id",
    ),
)
def ruling_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each ruling, with the rules behind its card's keywords in document order."""
    k = knowledge(Tables(spark, sf_dir))
    labels = cut(G.interval_labels(k.rules))
    keyed = k.card_keywords.select(F.col("card_id").alias("owner"), "keyword", F.lit(0).alias("nth"))
    found = A.candidate_rules(keyed, k.defined_by, labels, k.rules, most=2, snippet=20)
    own = k.rulings.join(found, F.col("card_id") == F.col("owner")).select("ruling_id", "place", "number", "snippet")
    return A.ruling_prompts(k.rulings.select("ruling_id", "text"), own)
