"""Rules-text queries: regions written as text files of rules, read line by line and parsed again; trees by interval labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.cuts import checkpoint_folder, cut
from ..sources import rules_text as X
from ..sources.snapshots import Store
from .binding import Tables
from .catalogue import register


def rule_lines(t: Tables) -> DataFrame:
    """(region, at, line): a document for each region, with a rule for each nation, subrules for market segments, suppliers as examples, and a glossary of nations."""
    region, nation = t.t("region").select("r_regionkey", "r_name"), t.t("nation").select("n_nationkey", "n_name", "n_regionkey")
    least = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("least"))
    at = lambda *k: F.struct(*[(F.lit(x) if isinstance(x, int) else x).cast("long").alias(f"k{i}") for i, x in enumerate(k)]).alias("at")
    number = F.format_string("10%d.%d", "n_regionkey", "n_nationkey")
    heads = (
        "concat('\\ufeffRules of ', r_name)", "concat('These rules are effective as of January ', r_regionkey + 1, ', 2024.')", "''", "'1. Trade'", "concat('10', r_regionkey, '. ', r_name)", "'Glossary'", "'Credits'", "''", "'1. Trade'", "''", "concat('10', r_regionkey, '. ', r_name)", "''",
    )
    out = region.select(F.col("r_regionkey").alias("region"), F.posexplode(F.array(*[F.expr(h) for h in heads])).alias("i", "line")).select("region", at(0, F.col("i"), 0, 0), "line")
    rules = nation.join(least, "n_regionkey").select(F.col("n_regionkey").alias("region"), at(1, F.col("n_nationkey"), 0, 0), F.concat(number, F.lit(". "), "n_name", F.lit(" trades. See rule 10"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("least").cast("string"), F.lit(" and rule 999.9.")).alias("line"))
    examples = t.t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), at(1, F.col("n_nationkey"), 1, F.col("s_suppkey")), F.concat(F.lit("Example: "), "s_name").alias("line"))
    sold = t.t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    letter = F.ascii("c_mktsegment")  # A, B, F, H, M
    subs = sold.select(F.col("n_regionkey").alias("region"), at(1, F.col("n_nationkey"), letter + 1, 0), F.concat(number, F.lower(F.substring("c_mktsegment", 1, 1)), F.lit(" "), F.col("c_mktsegment"), F.lit(" customers")).alias("line"))
    more = sold.select(F.col("n_regionkey").alias("region"), at(1, F.col("n_nationkey"), letter + 1, 1), F.concat(F.lit("   number "), F.col("n").cast("string"), F.lit("  ")).alias("line"))
    ends = region.select(F.col("r_regionkey").alias("region"), F.posexplode(F.array(*[F.lit(x) for x in ("", "Glossary", "", "Trade", "")])).alias("i", "line")).select("region", at(2, F.col("i"), 0, 0), "line")
    terms = nation.select(F.col("n_regionkey").alias("region"), "n_nationkey", F.posexplode(F.array("n_name", F.concat(F.lit("A nation. See rule "), number, F.lit(".")), F.lit(""))).alias("i", "line")).select("region", at(3, F.col("n_nationkey"), F.col("i"), 0), "line")
    credits = region.select(F.col("r_regionkey").alias("region"), at(4, 0, 0, 0), F.lit("Credits").alias("line"))
    for part in (rules, examples, subs, more, ends, terms, credits):
        out = out.unionByName(part)
    return out


def _written(spark: SparkSession, sf_dir: str, parse) -> DataFrame:
    """The documents as files, read and parsed; results are kept before the files are removed."""
    store = Store(spark, f"{checkpoint_folder(spark)}/rules-{uuid.uuid4().hex}")
    rows = rule_lines(Tables(spark, sf_dir))
    try:
        rows.repartition("region").sortWithinPartitions("region", "at").select("region", "line").write.partitionBy("region").text(store.root)
        lines = X.read_lines(spark, store.root)
        doc = F.regexp_extract("doc", "region=([0-9]+)", 1).cast("int").alias("region")
        return cut(parse(lines, doc))
    finally:
        fs, p = store._at("")
        fs.delete(p, True)


_NUMBER = "'10' || n_regionkey || '.' || n_nationkey"
_RULES_SQL = (
    "l AS (SELECT n_regionkey, min(n_nationkey) AS least FROM nation GROUP BY 1), "
    "ex AS (SELECT s_nationkey AS n_nationkey, count(*) AS n, md5(string_agg(s_name, ';' ORDER BY s_suppkey)) AS said FROM supplier GROUP BY 1), "
    "sg AS (SELECT c_nationkey AS n_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1, 2), "
    "r AS (SELECT r_regionkey AS region, '10' || r_regionkey AS number, 1 AS level, r_name AS text, CAST(NULL AS VARCHAR) AS parent, 0 AS n_examples, md5('') AS examples, '' AS refs, [-1, 0] AS spot FROM region "
    f"UNION ALL SELECT n_regionkey, {_NUMBER}, 2, n_name || ' trades. See rule 10' || n_regionkey || '.' || least || ' and rule 999.9.', '10' || n_regionkey, coalesce(n, 0), coalesce(said, md5('')), CASE WHEN n_nationkey <> least THEN '10' || n_regionkey || '.' || least ELSE '' END, [n_nationkey, 0] FROM nation JOIN l USING (n_regionkey) LEFT JOIN ex USING (n_nationkey) "
    f"UNION ALL SELECT n_regionkey, {_NUMBER} || lower(s[1]), 3, s || ' customers number ' || n, {_NUMBER}, 0, md5(''), '', [n_nationkey, ascii(s)] FROM nation JOIN sg USING (n_nationkey)) "
)


@register("rules_text_parse", f"WITH {_RULES_SQL} SELECT region, row_number() OVER (PARTITION BY region ORDER BY spot) AS place, number, level, text, parent, 'Trade' AS section, n_examples, examples, refs FROM r")
def rules_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of all documents in document order, with their examples as a digest."""

    def parse(lines, doc):
        place = F.row_number().over(Window.partitionBy("doc").orderBy("pos")).cast("long").alias("place")
        return X.parse_rules(lines).select(doc, place, "number", "level", "text", "parent", "section", F.size("examples").cast("long").alias("n_examples"), F.md5(F.array_join("examples", ";")).alias("examples"), F.array_join("refs", ",").alias("refs"))

    return _written(spark, sf_dir, parse)


@register("glossary_parse", f"SELECT n_regionkey AS region, n_name AS term, 'A nation. See rule ' || {_NUMBER} || '.' AS definition, {_NUMBER} AS refs, 'January ' || (n_regionkey + 1) || ', 2024' AS effective_date FROM nation")
def glossary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary entries with the rules that they name, and the date from which their document holds."""

    def parse(lines, doc):
        entries = X.parse_glossary(lines)
        out = entries.join(X.glossary_references(entries, X.parse_rules(lines)), ["doc", "term"], "left").join(X.effective_dates(lines), "doc")
        return out.select(doc, "term", "definition", F.array_join("refs", ",").alias("refs"), "effective_date")

    return _written(spark, sf_dir, parse)


def deep_tree(t: Tables) -> DataFrame:
    """(number, parent, pos) of regions, nations, suppliers and customers, and the customers' orders: four levels, in the order of their keys."""
    n = F.broadcast(t.t("nation"))
    at = F.format_string("R%d.%d", "n_regionkey", "n_nationkey")
    out = t.t("region").select(F.format_string("R%d", "r_regionkey").alias("number"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("pos"))
    out = out.unionByName(n.select(at.alias("number"), F.format_string("R%d", "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("pos")))
    suppliers = t.t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(at, F.lit(".s"), "s_suppkey").alias("number"), at.alias("parent"), F.col("s_suppkey").alias("pos"))
    customers = t.t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(at, F.lit(".c"), "c_custkey").alias("number"), at.alias("parent"), (F.col("c_custkey") + 1_000_000_000_000).alias("pos"), "c_custkey")
    orders = t.t("orders").join(customers.select("c_custkey", F.col("number").alias("parent")), F.col("o_custkey") == F.col("c_custkey")).select(F.concat("parent", F.lit(".o"), "o_orderkey").alias("number"), "parent", F.col("o_orderkey").alias("pos"))
    return out.unionByName(suppliers).unionByName(customers.drop("c_custkey")).unionByName(orders)


@register(
    "subtree_in_order",
    "WITH RECURSIVE t AS (SELECT 'R' || r_regionkey AS number, CAST(NULL AS VARCHAR) AS parent, CAST(r_regionkey AS BIGINT) AS pos FROM region UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey, 'R' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey || '.s' || s_suppkey, 'R' || n_regionkey || '.' || n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey || '.c' || c_custkey, 'R' || n_regionkey || '.' || n_nationkey, c_custkey + 1000000000000 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey || '.c' || c_custkey || '.o' || o_orderkey, 'R' || n_regionkey || '.' || n_nationkey || '.c' || c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), "
    "p AS (SELECT number, [number] AS up, [pos] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.number, list_append(p.up, t.number), list_append(p.path, t.pos) FROM p JOIN t ON t.parent = p.number), "
    "a AS (SELECT number, path, unnest(up) AS root, unnest(range(1, len(up) + 1)) AS depth FROM p) SELECT root, number, CAST(len(path) - depth AS BIGINT) AS distance, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM a",
)
def subtree_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subtree of the tree, itself first, in document order: ranges of interval labels, at any depth."""
    labels = cut(G.interval_labels(deep_tree(Tables(spark, sf_dir))))
    return G.subtrees_by_label(labels, labels.select("number"))
