"""Reports, samples and checks, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as V
from ..operators import reports as R
from .binding import Tables, sql
from .catalogue import register


@register(
    "refusal_outcomes",
    "WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'sufficient' WHEN 'O' THEN 'insufficient' WHEN 'P' THEN 'partial' END AS label, o_totalprice < 100000 AS refused FROM orders), "
    "b AS (SELECT CASE WHEN label = 'sufficient' THEN CASE WHEN refused THEN 'over_refusal' END WHEN label = 'insufficient' THEN CASE WHEN refused THEN 'correct_refusal' ELSE 'unsupported_answering' END WHEN label = 'partial' THEN CASE WHEN refused THEN 'partial_refused' ELSE 'partial_answered' END END AS bucket FROM r) "
    "SELECT bucket, count(*) AS n, bucket = 'over_refusal' AS blocks FROM b WHERE bucket IS NOT NULL GROUP BY 1",
)
def refusal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "sufficient").when(F.col("o_orderstatus") == "O", "insufficient").when(F.col("o_orderstatus") == "P", "partial")
    rows = Tables(spark, sf_dir).t("orders").select(status.alias("label"), (F.col("o_totalprice") < 100000).alias("refused"))
    return R.refusal_confusion(rows, "label", "refused")


@register("support_clusters", "SELECT conv_id, string_agg(CASE WHEN text LIKE '% the %' THEN '1' ELSE '0' END, '' ORDER BY turn, CASE WHEN text LIKE '% the %' THEN '1' ELSE '0' END) AS flags FROM conversations WHERE role = 'assistant' GROUP BY 1")
def support_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).t("conversations").where("role = 'assistant'")
    return R.cluster_flags(rows, "conv_id", "turn", F.coalesce(F.col("text").like("% the %"), F.lit(False)))


@register(
    "citation_distribution",
    "WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem WHERE l_discount >= 0.08), i AS (SELECT CAST(item AS VARCHAR) AS key, count(*) AS n FROM p GROUP BY 1), d AS (SELECT doc, count(*) AS k FROM p GROUP BY 1) "
    "SELECT 'total' AS section, 'all' AS key, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM i UNION ALL SELECT 'total', 'distinct', count(*) FROM i UNION ALL SELECT 'total', 'once', count(*) FROM i WHERE n = 1 UNION ALL (SELECT 'top', key, n FROM i ORDER BY n DESC, key LIMIT 5) "
    "UNION ALL SELECT 'per_document', CAST(k AS VARCHAR), count(*) FROM d GROUP BY k UNION ALL SELECT 'uncited', o_orderpriority, count(*) FROM orders WHERE o_orderkey NOT IN (SELECT doc FROM d) GROUP BY o_orderpriority",
)
def citation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    pairs = t.t("lineitem").where("l_discount >= 0.08").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item")).distinct()
    strata = t.t("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("stratum"))
    return R.distribution(pairs, strata, "doc", "item", "stratum")


@register("verdict_shares", "SELECT l_returnflag AS bucket, l_linestatus AS verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2")
def verdict_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).t("lineitem").select(F.col("l_returnflag").alias("bucket"), F.col("l_linestatus").alias("verdict"))
    return R.shares(rows, "bucket", "verdict")


@register("probe_decision", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS followed, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS leaks, CASE WHEN count(*) > 0 THEN least(1.0, round(3 / count(*), 6)) ELSE 1.0 END AS bound, "
          "count(*) > 0 AND count(*) FILTER (WHERE quality = 1) >= 0.8 * count(*) AND count(*) FILTER (WHERE toxic = 1 AND quality = 1) = 0 AS passed FROM labels")
def probe_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.probe_decision(Tables(spark, sf_dir).t("labels"), F.col("quality") == 1, (F.col("toxic") == 1) & (F.col("quality") == 1))


@register(
    "extraction_cost",
    "WITH s AS (SELECT source, count(*) AS n, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS input_tokens, count(*) * 70 AS output_tokens FROM documents GROUP BY 1) SELECT *, round((input_tokens * 0.15 + output_tokens * 0.6) / 1000000 / n * 1000, 6) AS usd_per_1000, round((input_tokens * 0.15 + output_tokens * 0.6) / 1000000 / n * 77999, 4) AS usd_corpus FROM s",
)
def extraction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cost_projection(Tables(spark, sf_dir).t("documents"), "source", "text", 0.15, 0.6, 70, 77_999)


@register(
    "annotation_progress",
    "WITH r AS (SELECT lang, source, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)) SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, count(quality) AS done, round(count(quality) / count(*), 6) AS share FROM r GROUP BY ROLLUP (lang, source)",
)
def annotation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    labels = t.t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = t.t("documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return R.progress(rows, F.col("quality").isNotNull(), "lang", "source")


@register(
    "gate_family_mix",
    sql("hosts rulings cites", ", a AS (SELECT DISTINCT ruling_id, number FROM cites JOIN rulings USING (ruling_id)) SELECT regexp_replace(number, '[a-km-np-z]+$', '') AS family, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, "
        "(SELECT round(count(DISTINCT a.ruling_id) / count(DISTINCT o_orderkey), 6) FROM orders LEFT JOIN a ON a.ruling_id = o_orderkey) AS covered FROM a GROUP BY 1"),
)
def gate_family_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    accepted = t.cites().join(t.rulings().select("ruling_id"), "ruling_id")
    return R.family_mix(accepted, "ruling_id", "number", t.t("orders").select(F.col("o_orderkey").alias("ruling_id")))


@register(
    "status_mix",
    "WITH r AS (SELECT l_returnflag AS seeded, CASE WHEN l_discount > 0.05 THEN 'R' ELSE l_returnflag END AS decided FROM lineitem), s AS (SELECT seeded AS status, count(*) AS seeded_n FROM r GROUP BY 1), d AS (SELECT decided AS status, count(*) AS decided_n, count(*) FILTER (WHERE decided <> seeded) AS changed FROM r GROUP BY 1) "
    "SELECT status, coalesce(seeded_n, 0) AS seeded_n, coalesce(decided_n, 0) AS decided_n, coalesce(changed, 0) AS changed FROM s FULL JOIN d USING (status)",
)
def status_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).t("lineitem").select(F.col("l_returnflag").alias("seeded"), F.when(F.col("l_discount") > 0.05, "R").otherwise(F.col("l_returnflag")).alias("decided"))
    return R.status_mix(rows, "decided", "seeded")


@register(
    "reaudit_agreement",
    "WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS a, CASE WHEN o_totalprice < 150000 THEN o_orderpriority ELSE '2-HIGH' END AS b FROM orders), c AS (SELECT a, b, CASE WHEN a IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE a END AS ca, CASE WHEN b IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE b END AS cb FROM a) "
    "SELECT count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END), 6) AS collapsed FROM c",
)
def reaudit_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).t("orders")
    second = o.select("o_orderkey", F.when(F.col("o_totalprice") < 150000, F.col("o_orderpriority")).otherwise("2-HIGH").alias("label"))
    return R.agreement(o.select("o_orderkey", F.col("o_orderpriority").alias("label")), second, ["o_orderkey"], "label", {"1-URGENT": "high", "2-HIGH": "high"})


@register("latest_verdict", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(Tables(spark, sf_dir).t("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@register(
    "by_severity",
    "WITH s AS (SELECT o_orderstatus AS status, count(*) AS n, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS severity FROM orders GROUP BY 1) SELECT status, n, severity, row_number() OVER (ORDER BY severity, status) AS place FROM s",
)
def by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = Tables(spark, sf_dir).t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("severity", R.severity(F.col("status"), ["P", "O"]).cast("int"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("severity", "status")))  # a row for each status


_WANTED = {"de": 40, "en": 5, "es": 9, "fr": 60, "xx": 7}


@register(
    "sample_shortages",
    "WITH q(stratum, wanted) AS (VALUES ('de', 40), ('en', 5), ('es', 9), ('fr', 60), ('xx', 7)), c AS (SELECT lang AS stratum, count(*) AS available FROM documents GROUP BY 1) SELECT stratum, CAST(wanted AS BIGINT) AS wanted, coalesce(available, 0) AS available, least(wanted, coalesce(available, 0), 50) AS drawn, least(wanted, 50) - least(wanted, coalesce(available, 0), 50) AS short FROM q LEFT JOIN c USING (stratum)",
)
def sample_shortages(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = spark.createDataFrame(list(_WANTED.items()), "stratum string, quota long")
    counts = Tables(spark, sf_dir).t("documents").groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n_rows"))
    return R.shortages(counts, quotas, "stratum", 50)


@register(
    "status_mix_sample",
    sql("legal", ", q(status, quota) AS (VALUES ('legal', 24), ('banned', 15), ('not_legal', 12), ('restricted', 9)), r AS (SELECT card_id || '|' || format AS k, status, md5('29|' || card_id || '|' || format) AS d FROM legal), "
        "n AS (SELECT k, status, d, row_number() OVER (PARTITION BY status ORDER BY d, k) AS rn FROM r) SELECT k, status FROM n LEFT JOIN q USING (status) ORDER BY CASE WHEN rn > coalesce(quota, 0) THEN 1 ELSE 0 END, d, k LIMIT 60"),
)
def status_mix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).legalities().select(F.concat_ws("|", F.col("card_id").cast("string"), "format").alias("k"), "status")
    mix = spark.createDataFrame([("legal", 24), ("banned", 15), ("not_legal", 12), ("restricted", 9)], "status string, quota int")
    return R.mix_with_top_up(rows, mix, "status", "k", 60, 29).select("k", "status")


@register(
    "depth_disagreements",
    "WITH g AS (SELECT DISTINCT l_orderkey AS doc, 'R' || (l_partkey % 50) || substr('abcdefg', 1 + CAST(l_linenumber AS INT) % 3, 1) AS item FROM lineitem WHERE l_quantity >= 25), p AS (SELECT DISTINCT l_orderkey AS doc, 'R' || (l_partkey % 50) || substr('abcdefg', 2 + CAST(l_linenumber AS INT) % 2, 1) AS item FROM lineitem WHERE l_orderkey IN (SELECT doc FROM g)), "
    "x AS (SELECT doc, item, 'fn' AS kind FROM (SELECT * FROM g EXCEPT SELECT * FROM p) UNION ALL SELECT doc, item, 'fp' FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) "
    "SELECT doc, item, kind, count(DISTINCT kind) OVER (PARTITION BY doc, regexp_replace(item, '[a-km-np-z]+$', '')) = 2 AS depth_only FROM x",
)
def depth_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Tables(spark, sf_dir).t("lineitem")
    item = lambda at: F.concat(F.lit("R"), (F.col("l_partkey") % 50).cast("string"), F.substring(F.lit("abcdefg"), at, F.lit(1)))
    gold = line.where("l_quantity >= 25").select(F.col("l_orderkey").alias("doc"), item(F.col("l_linenumber").cast("int") % 3 + 1).alias("item"))
    predicted = line.select(F.col("l_orderkey").alias("doc"), item(F.col("l_linenumber").cast("int") % 2 + 2).alias("item"))
    return R.disagreements(V.pair_counts(gold, predicted, "doc", "item"), "doc", "item")


@register("disagreement_sample", "SELECT doc_id FROM labels WHERE quality = toxic GROUP BY 1 ORDER BY md5('31|' || doc_id), doc_id LIMIT 40")
def disagreement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frozen_sample(Tables(spark, sf_dir).t("labels").where("quality = toxic").select("doc_id").distinct(), "doc_id", 40, 31)


@register(
    "label_drift",
    "WITH a AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), f AS (SELECT * FROM a WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM a WHERE doc_id % 5 <> 0) "
    "SELECT coalesce(f.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'gone' WHEN f.doc_id IS NULL THEN 'new' ELSE 'changed' END AS change FROM f FULL JOIN n ON f.doc_id = n.doc_id WHERE n.doc_id IS NULL OR f.doc_id IS NULL OR f.quality <> n.quality OR f.toxic <> n.toxic",
)
def label_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Tables(spark, sf_dir).t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    now = a.where("doc_id % 5 <> 0").withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return R.drift(a.where("doc_id % 11 <> 0"), now, "doc_id")


@register("unused_vocabulary", sql("card_keywords", "SELECT DISTINCT keyword FROM card_keywords WHERE keyword NOT IN (SELECT keyword FROM card_keywords JOIN part ON p_partkey = card_id WHERE p_size <= 2 AND p_brand = 'Brand#1')"))
def unused_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    used = t.card_keywords().join(t.t("part").where("p_size <= 2 and p_brand = 'Brand#1'").select(F.col("p_partkey").alias("card_id")), "card_id")
    return R.complement(t.card_keywords(), used, "keyword")


@register(
    "keys_outside_set",
    "WITH u AS (SELECT p_partkey AS id, [x FOR x IN string_split(p_name, ' ') IF x NOT IN ('red', 'small', 'ring', 'widget')] AS w FROM part) SELECT id, array_to_string(w, ' ') AS unknown FROM u WHERE len(w) > 0",
)
def keys_outside_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).t("part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"))
    out = R.not_subset(rows, "words", F.array(*[F.lit(w) for w in ("red", "small", "ring", "widget")]))
    return out.select("id", F.array_join("unknown", " ").alias("unknown"))


@register(
    "upsert_counters",
    "WITH o AS (SELECT c_custkey AS id, c_name AS text FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN c_name || '!' ELSE c_name END AS text FROM customer WHERE c_custkey % 4 <> 0) "
    "SELECT count(n.id) AS rows, count(*) FILTER (WHERE o.id IS NULL) AS created, count(*) FILTER (WHERE n.id IS NULL) AS deleted, count(*) FILTER (WHERE o.text <> n.text) AS changed FROM o FULL JOIN n ON o.id = n.id",
)
def upsert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), "c_acctbal")
    new = c.where("id % 4 <> 0").select("id", F.when(F.col("c_acctbal") < 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return R.upsert_counters(c.where("id % 3 <> 0").select("id", "text"), new, "id")


@register(
    "sufficiency_status",
    "WITH r AS (SELECT o_orderpriority AS stratum, CASE o_orderstatus WHEN 'F' THEN 'sufficient' WHEN 'O' THEN 'insufficient' END AS label FROM orders) SELECT stratum, count(*) AS n, count(label) AS labelled, count(*) FILTER (WHERE label = 'sufficient') AS sufficient, count(label) = count(*) AND count(*) FILTER (WHERE label = 'sufficient') >= 10 AS enough FROM r GROUP BY 1",
)
def sufficiency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "sufficient").when(F.col("o_orderstatus") == "O", "insufficient")
    rows = Tables(spark, sf_dir).t("orders").select(F.col("o_orderpriority").alias("stratum"), status.alias("label"))
    return R.sufficiency_status(rows, "stratum", "label", 10)


@register(
    "citations_in_context",
    "WITH o AS (SELECT o_orderkey AS id, 'See rule ' || (100 + o_custkey % 900) || '.' || (o_orderkey % 20) || CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE '' END || ',  not ' || o_custkey || ' or 613.4' || chr(10) || ' here ' || o_orderpriority AS text FROM orders), "
    "m AS (SELECT id, text, regexp_extract_all(text, '\\b([0-9]{3}\\.[0-9]+[a-z]?)\\b', 1) AS ns FROM o), a AS (SELECT id, text, unnest(ns) AS number, generate_subscripts(ns, 1) AS nth FROM m), s AS (SELECT *, CASE WHEN nth = 1 THEN instr(text, number) ELSE length(text) - length(' here ' || split_part(text, ' here ', 2)) - length(number) END - 1 AS start FROM a) "
    "SELECT id, number, CAST(start AS INT) AS start, CAST(start + length(number) AS INT) AS \"end\", trim(regexp_replace(substr(text, greatest(start - 60, 0) + 1, start + length(number) + 60 - greatest(start - 60, 0)), '\\s+', ' ', 'g')) AS context FROM s",
)
def citations_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).t("orders")
    text = F.concat(
        F.lit("See rule "), (F.col("o_custkey") % 900 + 100).cast("string"), F.lit("."), (F.col("o_orderkey") % 20).cast("string"), F.when(F.col("o_orderstatus") == "F", "a").otherwise(""),
        F.lit(",  not "), F.col("o_custkey").cast("string"), F.lit(" or 613.4\n here "), F.col("o_orderpriority"),
    )
    found = o.select(F.col("o_orderkey").alias("id"), F.explode(X.located_citations(text)).alias("c"))
    return found.select("id", "c.number", "c.start", "c.end", "c.context")
