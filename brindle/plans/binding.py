"""How the generic graph and text operators are bound to the driver's tables.

A part is a card, the words of its name and its lower-cased type are its keywords, an order is a ruling hosted by its least part and
mentioning the others, regions, nations, suppliers and customers are a three-level rule tree, and return flags are formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The driver's tables of one directory, and the graph's node and edge tables made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cards(self) -> DataFrame:
        return self.t("part").select(
            F.col("p_partkey").alias("card_id"), F.col("p_name").alias("name"), F.lower("p_name").alias("normalized_name"),
            F.col("p_type").alias("type_line"), F.col("p_size").cast("long").alias("cmc"),
        )

    def card_keywords(self) -> DataFrame:
        words = F.array_union(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type")))
        return self.t("part").select(F.col("p_partkey").alias("card_id"), F.explode(words).alias("keyword")).where("keyword <> ''").distinct()

    def defined_by(self) -> DataFrame:
        """keyword -> rule number of a nation; which one follows from the word alone."""
        nation = ((F.ascii("keyword") + 7 * F.length("keyword")) % 25).cast("int")
        kw = self.card_keywords().select("keyword").distinct().withColumn("n_nationkey", nation)
        n = self.t("nation")
        return kw.join(F.broadcast(n), "n_nationkey").select("keyword", F.format_string("R%d.%d", "n_regionkey", "n_nationkey").alias("number"))

    def rules(self) -> DataFrame:
        """number, parent, level, text: regions, their nations, and the nations' suppliers and customers."""
        r, n = self.t("region"), self.t("nation")
        chapter = r.select(F.format_string("R%d", "r_regionkey").alias("number"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), F.col("r_name").alias("text"))
        at = F.format_string("R%d.%d", "n_regionkey", "n_nationkey")
        rule = n.select(at.alias("number"), F.format_string("R%d", "n_regionkey").alias("parent"), F.lit(2).alias("level"), F.col("n_name").alias("text"))
        out = chapter.unionByName(rule)
        for table, key, nation, name, tag in (("supplier", "s_suppkey", "s_nationkey", "s_name", "s"), ("customer", "c_custkey", "c_nationkey", "c_name", "c")):
            leaf = self.t(table).join(F.broadcast(n), F.col(nation) == F.col("n_nationkey"))
            leaf = leaf.select(F.format_string(f"R%d.%d.{tag}%d", "n_regionkey", "n_nationkey", key).alias("number"), at.alias("parent"), F.lit(3).alias("level"), F.col(name).alias("text"))
            out = out.unionByName(leaf)
        return out

    def references(self) -> DataFrame:
        """Directed edges between nation rules: a supplier's to a customer's, where quantity and discount are high."""
        line = self.t("lineitem").where("l_quantity >= 49 and l_discount >= 0.09").select("l_orderkey", "l_suppkey")
        o, c, s = self.t("orders").select("o_orderkey", "o_custkey"), self.t("customer").select("c_custkey", "c_nationkey"), self.t("supplier").select("s_suppkey", "s_nationkey")
        n = F.broadcast(self.t("nation").select("n_nationkey", "n_regionkey"))
        pairs = (
            line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .where("s_nationkey <> c_nationkey").select("s_nationkey", "c_nationkey").distinct()
        )
        a = n.select(F.col("n_nationkey").alias("s_nationkey"), F.format_string("R%d.%d", "n_regionkey", "n_nationkey").alias("src"))
        b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.format_string("R%d.%d", "n_regionkey", "n_nationkey").alias("dst"))
        return pairs.join(F.broadcast(a), "s_nationkey").join(F.broadcast(b), "c_nationkey").select("src", "dst")

    def order_parts(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_orderkey").alias("ruling_id"), F.col("l_partkey").alias("card_id")).distinct()

    def rulings(self) -> DataFrame:
        host = self.t("lineitem").groupBy(F.col("l_orderkey").alias("ruling_id")).agg(F.min("l_partkey").alias("card_id"))
        o = self.t("orders").select(F.col("o_orderkey").alias("ruling_id"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"), F.col("o_orderpriority").alias("text"))
        return o.join(host, "ruling_id")

    def mentions(self) -> DataFrame:
        host = self.t("lineitem").groupBy(F.col("l_orderkey").alias("ruling_id")).agg(F.min("l_partkey").alias("host"))
        return self.order_parts().join(host, "ruling_id").where("card_id <> host").select("ruling_id", "card_id")

    def cites(self) -> DataFrame:
        """ruling -> the rule of its customer's nation."""
        c = self.t("customer").select("c_custkey", "c_nationkey")
        n = F.broadcast(self.t("nation").select("n_nationkey", "n_regionkey"))
        o = self.t("orders").select(F.col("o_orderkey").alias("ruling_id"), "o_custkey")
        joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select("ruling_id", F.format_string("R%d.%d", "n_regionkey", "n_nationkey").alias("number"))

    def legalities(self) -> DataFrame:
        """(card, format, status): the status by the part's summed discount in cents under a return flag."""
        cents = F.sum(F.round(F.col("l_discount") * 100).cast("long")) % 4
        status = F.when(cents == 0, "banned").when(cents == 1, "restricted").when(cents == 2, "not_legal").otherwise("legal")
        return self.t("lineitem").groupBy(F.col("l_partkey").alias("card_id"), F.col("l_returnflag").alias("format")).agg(status.alias("status"))


#: The same tables for the oracle: common table expressions that each query's SQL picks from.
CTE = {
    "cards": "cards AS (SELECT p_partkey AS card_id, p_name AS name, lower(p_name) AS normalized_name, p_type AS type_line, CAST(p_size AS BIGINT) AS cmc FROM part)",
    "card_keywords": "card_keywords AS (SELECT DISTINCT card_id, keyword FROM (SELECT p_partkey AS card_id, unnest(string_split(lower(p_name), ' ')) AS keyword FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part) WHERE keyword <> '')",
    "defined_by": "defined_by AS (SELECT keyword, 'R' || n_regionkey || '.' || n_nationkey AS number FROM (SELECT DISTINCT keyword FROM card_keywords) JOIN nation ON n_nationkey = (ascii(keyword) + 7 * length(keyword)) % 25)",
    "rules": "rules AS (SELECT 'R' || r_regionkey AS number, CAST(NULL AS VARCHAR) AS parent, 1 AS level, r_name AS text FROM region UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey, 'R' || n_regionkey, 2, n_name FROM nation "
    "UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey || '.s' || s_suppkey, 'R' || n_regionkey || '.' || n_nationkey, 3, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey || '.c' || c_custkey, 'R' || n_regionkey || '.' || n_nationkey, 3, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "refs": "refs AS (SELECT DISTINCT 'R' || a.n_regionkey || '.' || a.n_nationkey AS src, 'R' || b.n_regionkey || '.' || b.n_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE l_quantity >= 49 AND l_discount >= 0.09 AND s_nationkey <> c_nationkey)",
    "hosts": "hosts AS (SELECT l_orderkey AS ruling_id, min(l_partkey) AS card_id FROM lineitem GROUP BY 1)",
    "rulings": "rulings AS (SELECT o_orderkey AS ruling_id, card_id, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS published_at, o_orderpriority AS text FROM orders JOIN hosts ON o_orderkey = ruling_id)",
    "mentions": "mentions AS (SELECT DISTINCT l.l_orderkey AS ruling_id, l.l_partkey AS card_id FROM lineitem l JOIN hosts h ON l.l_orderkey = h.ruling_id WHERE l.l_partkey <> h.card_id)",
    "cites": "cites AS (SELECT o_orderkey AS ruling_id, 'R' || n_regionkey || '.' || n_nationkey AS number FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "legal": "legal AS (SELECT l_partkey AS card_id, l_returnflag AS format, CASE sum(CAST(round(l_discount * 100) AS BIGINT)) % 4 WHEN 0 THEN 'banned' WHEN 1 THEN 'restricted' WHEN 2 THEN 'not_legal' ELSE 'legal' END AS status FROM lineitem GROUP BY 1, 2)",
}


def sql(names: str, body: str) -> str:
    """``body`` after the common table expressions named, in that order."""
    return "WITH RECURSIVE " + ", ".join(CTE[n] for n in names.split()) + " " + body if names else body
