"""Evaluation, sampling and accounting queries, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import evaluation as V
from ..operators import reports as R
from .binding import Tables
from .catalogue import register

# Gold: an order's parts; predicted: those with a quantity of 20 or more, and a wrong part for some lines.  Stratum: the order's priority.
_PAIRS = (
    "gold AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem WHERE l_orderkey % 3 <> 0), pred AS (SELECT DISTINCT l_orderkey AS doc, CASE WHEN l_suppkey % 9 = 0 THEN l_partkey + 1 ELSE l_partkey END AS item FROM lineitem WHERE l_quantity >= 20), "
    "docs AS (SELECT DISTINCT doc FROM gold), c AS (SELECT coalesce(g.doc, p.doc) AS doc, coalesce(g.item, p.item) AS item, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN p.doc IS NULL THEN 0 ELSE 1 END AS p "
    "FROM gold g FULL JOIN (SELECT pred.* FROM pred JOIN docs USING (doc)) p ON g.doc = p.doc AND g.item = p.item)"
)
_PRF = (
    "tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1"
)
_SUMS = "CAST(sum(g * p) AS BIGINT) AS tp, CAST(sum((1 - g) * p) AS BIGINT) AS fp, CAST(sum(g * (1 - p)) AS BIGINT) AS fn"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Tables(spark, sf_dir).t("lineitem")
    gold = line.where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"))
    wrong = F.when(F.col("l_suppkey") % 9 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    return V.pair_counts(gold, line.where("l_quantity >= 20").select(F.col("l_orderkey").alias("doc"), wrong.alias("item")), "doc", "item")


@register("micro_prf", f"WITH {_PAIRS} SELECT {_PRF} FROM (SELECT {_SUMS} FROM c)")
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prf(_pairs(spark, sf_dir))


@register(
    "prf_by_stratum",
    f"WITH {_PAIRS}, s AS (SELECT c.*, coalesce(o_orderpriority, 'unstratified') AS stratum FROM c LEFT JOIN orders ON o_orderkey = doc AND o_orderkey % 5 <> 0), u AS (SELECT * FROM s UNION ALL SELECT doc, item, g, p, 'all' FROM s) SELECT stratum, {_PRF} FROM (SELECT stratum, {_SUMS} FROM u GROUP BY 1)",
)
def prf_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = Tables(spark, sf_dir).t("orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("stratum"))
    return V.prf_by_stratum(_pairs(spark, sf_dir), strata, "doc", "stratum")


_FAM = "regexp_replace(CAST(100 + l_partkey % 40 AS VARCHAR) || '.' || l_linenumber || {s}, '[a-km-np-z]+$', '')"


@register(
    "prf_family",
    f"WITH gold AS (SELECT DISTINCT l_orderkey AS doc, {_FAM.format(s='chr(CAST(97 + l_suppkey % 3 AS INT))')} AS item FROM lineitem), pred AS (SELECT DISTINCT l_orderkey AS doc, {_FAM.format(s='chr(CAST(98 + l_suppkey % 2 AS INT))')} AS item FROM lineitem WHERE l_quantity >= 10), "
    "c AS (SELECT coalesce(g.doc, p.doc) AS doc, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN p.doc IS NULL THEN 0 ELSE 1 END AS p FROM gold g FULL JOIN pred p ON g.doc = p.doc AND g.item = p.item) " + f"SELECT {_PRF} FROM (SELECT {_SUMS} FROM c)",
)
def prf_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Tables(spark, sf_dir).t("lineitem")
    number = lambda first, k: F.concat((F.col("l_partkey") % 40 + 100).cast("string"), F.lit("."), "l_linenumber", F.expr(f"chr({first} + l_suppkey % {k})")).alias("item")
    gold, pred = line.select(F.col("l_orderkey").alias("doc"), number(97, 3)), line.where("l_quantity >= 10").select(F.col("l_orderkey").alias("doc"), number(98, 2))
    return V.prf(V.pair_counts(V.roll_up(gold, "doc", "item"), V.roll_up(pred, "doc", "item"), "doc", "item"))


_FOUND = (
    "q AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS stratum, text FROM benchmark), f AS (SELECT q.item_id, any_value(stratum) AS stratum, count(doc_id) FILTER (WHERE contains(d.text, q.text)) AS n, count(doc_id) AS near "
    "FROM q LEFT JOIN documents d ON contains(' ' || d.text || ' ', ' ' || split_part(q.text, ' ', 2) || ' ' || split_part(q.text, ' ', 3) || ' ' || split_part(q.text, ' ', 4) || ' ') GROUP BY 1)"
)


@register("hit_rate_by_stratum", f"WITH {_FOUND} SELECT coalesce(stratum, 'all') AS stratum, count(*) AS n, count(*) FILTER (WHERE n > 0) AS hits, count(*) FILTER (WHERE near > 0) AS family_hits, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN near > 0 THEN 1.0 ELSE 0.0 END), 6) AS family_rate FROM f GROUP BY GROUPING SETS ((), (stratum))")
def hit_rate_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the items that stand whole in some document, and of those of which a key of three words does (the family).

    Items are a stated query set.  They meet documents by those three words, made within each document's row, so no pair is formed without a shared key
    and only documents that share one are looked at whole.
    """
    t = Tables(spark, sf_dir)
    key = F.concat_ws(" ", *[F.split_part("text", F.lit(" "), F.lit(i)) for i in (2, 3, 4)])
    q = t.t("benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("stratum"), F.col("text").alias("needle"), key.alias("key"))
    docs = t.t("documents").select("doc_id", "text")
    keys = q.select("key").distinct()
    held = docs.select("doc_id", "text", F.split("text", " ").alias("_w"))
    grams = F.filter(F.transform("_w", lambda w, i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))), lambda g: g != "")
    found = held.select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(keys, "key", "left_semi").distinct()
    near = found.join(q, "key").join(docs, "doc_id").select("item_id", F.col("text").contains(F.col("needle")).cast("int").alias("hit"), F.lit(1).alias("near"))
    out = V.hit_rates(q, near.withColumnRenamed("near", "family"), "item_id", "stratum", "hit", "family")
    return out.withColumnsRenamed({"hit_hits": "hits", "hit_rate": "rate"})


@register("recall_by_stratum", "WITH gold AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem), r AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE item % 3 <> 0) AS found FROM gold GROUP BY 1) SELECT o_orderpriority AS stratum, count(*) AS n, round(avg(found / n), 6) AS recall FROM r JOIN orders ON o_orderkey = doc GROUP BY 1")
def recall_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    gold = t.t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"))
    rows = V.retrieval_recall(gold, gold.where("item % 3 <> 0"), "doc", "item").join(t.t("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("stratum")), "doc")
    return V.mean_by_stratum(rows, "stratum", "recall")


@register(
    "mcnemar",
    "WITH n AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_b FROM labels), "
    "k AS (SELECT only_a, only_b, unnest(range(0, least(only_a, only_b) + 1)) AS k FROM n), t AS (SELECT only_a, only_b, sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) + (only_a + only_b) * ln(0.5))) AS tail FROM k GROUP BY 1, 2) "
    "SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * tail) END, 6) AS p_value FROM t",
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Tables(spark, sf_dir).t("labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return V.mcnemar(pairs, "a", "b")


_QUOTA = (
    "cnt AS (SELECT lang AS stratum, count(*) AS n_rows FROM documents GROUP BY 1), sh AS (SELECT stratum, n_rows, n_rows * 50 / sum(n_rows) OVER () AS share FROM cnt), fl AS (SELECT *, CAST(floor(share) AS BIGINT) AS base, round(share - floor(share), 9) AS rest FROM sh), "
    "quotas AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 50 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM fl)"
)


def _quotas(docs: DataFrame) -> DataFrame:
    return V.allocate(docs.groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n_rows")), "stratum", 50)


@register("allocate_quota", f"WITH {_QUOTA} SELECT stratum, CAST(quota AS BIGINT) AS quota FROM quotas")
def allocate_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(Tables(spark, sf_dir).t("documents"))


@register("stratified_sample", f"WITH {_QUOTA} SELECT doc_id, d.stratum FROM (SELECT doc_id, lang AS stratum, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS rn FROM documents) d JOIN quotas USING (stratum) WHERE rn <= quota")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).t("documents")
    rows = docs.select("doc_id", F.col("lang").alias("stratum"))
    return V.stratified_draw(rows, _quotas(docs), "stratum", "doc_id", 7).select("doc_id", "stratum")


@register(
    "derangement_control",
    "WITH l AS (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY 1, 2), o AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id FROM l), w AS (SELECT conv_id, id, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(lead(id) OVER (PARTITION BY conv_id ORDER BY md5('5|' || id), id), first_value(id) OVER (PARTITION BY conv_id ORDER BY md5('5|' || id), id)) AS shuffled FROM o) SELECT conv_id, id, shuffled FROM w WHERE n > 1",
)
def derangement_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).t("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id")).distinct()
    return V.derangement(c.withColumn("value", F.col("id")), "conv_id", "id", "value", 5).select("conv_id", "id", "shuffled")




def _interval_sql(rows: str, seed: int, resamples: int = 500) -> str:
    """SQL for ``bootstrap_ratio`` over rows (cluster, x, y)."""
    u = f"CAST('0x' || substr(md5('{seed}|' || b || '|' || cluster), 1, 8) AS BIGINT)"
    w = " + ".join(f"CAST({u} >= {x} AS BIGINT)" for x in V._POISSON)
    return (
        f"cl AS ({rows}), d AS (SELECT b, x, y, {w} AS w FROM cl, (SELECT unnest(range(0, {resamples})) AS b)), v AS (SELECT b, sum(w * x) / sum(w * y) AS v FROM d WHERE w > 0 GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, count(*) OVER () AS n FROM v) "
        "SELECT (SELECT round(sum(x) / sum(y), 6) FROM cl) AS point, round(max(CASE WHEN rn = least(n - 1, CAST(floor(0.025 * n) AS BIGINT)) THEN v END), 6) AS low, round(max(CASE WHEN rn = least(n - 1, CAST(floor(0.975 * n) AS BIGINT)) THEN v END), 6) AS high FROM r"
    )


_BY_SOURCE = "SELECT source AS cluster, sum({0}) AS x, count(*) AS y FROM labels JOIN documents USING (doc_id) GROUP BY 1"


def _by_source(t: Tables, what: str) -> DataFrame:
    rows = t.t("labels").join(t.t("documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy(F.col("source").alias("cluster")).agg(F.sum(what).alias("x"), F.count(F.lit(1)).alias("y"))


@register("cluster_ci", "WITH " + _interval_sql(_BY_SOURCE.format("toxic"), 13))
def cluster_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bootstrap_ratio(_by_source(Tables(spark, sf_dir), "toxic"), "x", "y", 500)


@register("document_mean_ci", "WITH " + _interval_sql("SELECT user_id AS cluster, avg(value) AS x, 1 AS y FROM events GROUP BY 1", 17))
def document_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = Tables(spark, sf_dir).t("events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    return V.bootstrap_mean(per, "user_id", "mean", 500, 17)


_SPREAD = "sqrt(sum(w * q) / sum(w * n) - (sum(w * s) / sum(w * n)) * (sum(w * s) / sum(w * n)))"


@register(
    "deviation_ci",
    "WITH " + _interval_sql("SELECT user_id AS cluster, count(*) AS n, sum(value) AS s, sum(value * value) AS q, 0 AS x, 0 AS y FROM events GROUP BY 1", 19)
    .replace("SELECT b, x, y, ", "SELECT b, n, s, q, ").replace("sum(w * x) / sum(w * y)", _SPREAD).replace("round(sum(x) / sum(y), 6)", "round(" + _SPREAD.replace("w * ", "") + ", 6)"),
)
def deviation_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard deviation of all values with its interval over resampled users: a statistic that is no ratio, from three sums."""
    value = F.col("value")
    per = Tables(spark, sf_dir).t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    spread = lambda m: F.sqrt(m["q"] / m["n"] - (m["s"] / m["n"]) * (m["s"] / m["n"]))
    return V.bootstrap(per, "user_id", {c: F.col(c) for c in ("n", "s", "q")}, spread, 500, 19)


@register(
    "mcnemar_by_language",
    "WITH n AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_b FROM labels JOIN documents USING (doc_id) GROUP BY 1), "
    "k AS (SELECT *, unnest(range(0, least(only_a, only_b) + 1)) AS k FROM n), t AS (SELECT lang, only_a, only_b, sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) + (only_a + only_b) * ln(0.5))) AS tail FROM k GROUP BY 1, 2, 3) "
    "SELECT lang, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * tail) END, 6) AS p_value FROM t",
)
def mcnemar_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    pairs = t.t("labels").join(t.t("documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return V.mcnemar(pairs, "a", "b", "lang")


@register(
    "control_comparison",
    "WITH a AS (WITH " + _interval_sql(_BY_SOURCE.format("quality"), 13) + "), c AS (WITH " + _interval_sql(_BY_SOURCE.format("toxic"), 14)
    + ") SELECT a.point AS real_point, a.low AS real_low, a.high AS real_high, c.point AS control_point, c.low AS control_low, c.high AS control_high, a.low > c.high AS separated FROM a, c",
)
def control_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return R.control_comparison(V.bootstrap_ratio(_by_source(t, "quality"), "x", "y", 500, 13), V.bootstrap_ratio(_by_source(t, "toxic"), "x", "y", 500, 14))


@register("freq_table_with_share", "SELECT p_brand AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def freq_table_with_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frequency_table(Tables(spark, sf_dir).t("part"), "p_brand", 10)


@register(
    "median_p95",
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, (SELECT round(median(value), 6) FROM events e WHERE e.event_type = r.event_type) AS median, round(max(CASE WHEN rn = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN value END), 6) AS p95 FROM r GROUP BY 1",
)
def median_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p95": V.quantile_at(0.95)}
    out = V.order_statistics(Tables(spark, sf_dir).t("events"), "event_type", "value", places)
    return out.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), F.round("p95", 6).alias("p95"))


@register(
    "snapshot_hash",
    "WITH l AS (SELECT lang, sha256(doc_id || '|' || source) AS d FROM documents), p AS (SELECT lang, substr(d, 1, 3) || ':' || sha256(string_agg(d, chr(10) ORDER BY d)) AS h FROM l GROUP BY lang, substr(d, 1, 3)) SELECT lang, sha256(string_agg(h, chr(10) ORDER BY h)) AS sha256 FROM p GROUP BY 1",
)
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tree_hash(Tables(spark, sf_dir).t("documents"), "lang", "doc_id", "source")


@register(
    "refusal_confusion",
    "SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'false_refusal' WHEN quality = 1 THEN 'answered' WHEN toxic = 1 THEN 'refused' ELSE 'missed_refusal' END AS bucket, count(*) AS n FROM labels GROUP BY 1",
)
def refusal_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    bucket = F.when(q & t, "false_refusal").when(q, "answered").when(t, "refused").otherwise("missed_refusal")
    return Tables(spark, sf_dir).t("labels").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("failure_histogram", "SELECT l_returnflag || l_linestatus AS code, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1 ORDER BY n DESC, code")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Tables(spark, sf_dir).t("lineitem").where("l_discount > 0.05")
    return V.histogram(line.select(F.concat("l_returnflag", "l_linestatus").alias("code")), "code")


@register(
    "claim_coverage",
    "WITH s AS (SELECT conv_id, text LIKE '% the %' AS cited, length(text) >= 40 AS factual FROM conversations WHERE role = 'assistant') SELECT count(*) FILTER (WHERE factual AND cited) AS cited, count(*) FILTER (WHERE factual) AS factual, count(*) FILTER (WHERE NOT factual) AS excluded, count(*) AS segmented, count(DISTINCT CASE WHEN factual THEN conv_id END) AS clusters, "
    "count(DISTINCT conv_id) AS answers, round(count(*) FILTER (WHERE factual AND cited) / nullif(count(*) FILTER (WHERE factual), 0), 6) AS rate, count(*) FILTER (WHERE NOT factual) / count(*) > 0.20 AS void FROM s",
)
def claim_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).t("conversations").where("role = 'assistant'").select("conv_id", F.col("text").like("% the %").alias("c"), (F.length("text") >= 40).alias("f"))
    return V.coverage(s, "conv_id", "c", "f")


@register("cost_projection", "SELECT source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, round(sum(greatest(1, length(text) // 4)) * 0.15 / 1000000, 9) AS usd FROM documents GROUP BY 1")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(estimate_tokens(F.col("text")))
    return Tables(spark, sf_dir).t("documents").groupBy("source").agg(tokens.alias("tokens"), F.round(tokens * 0.15 / 1_000_000, 9).alias("usd"))


@register("legality_map_explode", "SELECT user_id, k AS key, count(*) AS n FROM (SELECT user_id, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2")
def legality_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).t("events").select("user_id", F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("user_id", "key").agg(F.count(F.lit(1)).alias("n"))


@register("counts_with_zeros", "SELECT s.v AS stratum, count(doc_id) AS n FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it', 'pt']) AS v) s LEFT JOIN documents ON lang = v GROUP BY 1")
def counts_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts_of(Tables(spark, sf_dir).t("documents").withColumnRenamed("lang", "stratum"), "stratum", ("de", "en", "es", "fr", "it", "pt"))


@register("annotator_agreement", "SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS exact FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.t("labels").join(t.t("documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("exact"))


@register("gold_vs_predicted_diff", "WITH a AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem WHERE l_quantity >= 30), b AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem WHERE l_discount >= 0.03) SELECT doc, item, 'fn' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT doc, item, 'fp' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def gold_vs_predicted_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Tables(spark, sf_dir).t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"), "l_quantity", "l_discount")
    c = V.pair_counts(line.where("l_quantity >= 30"), line.where("l_discount >= 0.03"), "doc", "item")
    only_b = line.where("l_discount >= 0.03").select("doc", "item").distinct().join(line.where("l_quantity >= 30").select("doc").distinct(), "doc", "left_anti")
    both = c.where("g <> p").select("doc", "item", F.when(F.col("g") == 1, "fn").otherwise("fp").alias("kind"))
    return both.unionByName(only_b.withColumn("kind", F.lit("fp")))


@register("outcome_pivot", "SELECT l_returnflag AS kind, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Tables(spark, sf_dir).t("lineitem").groupBy(F.col("l_returnflag").alias("kind")).pivot("l_linestatus", ["F", "O"]).count()
    return out.select("kind", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("O", F.lit(0)).alias("O"))
