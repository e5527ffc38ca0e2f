"""The extraction pipeline over all orders as rulings: names and numbers that their texts hold, beside a stream of a model's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction
from ..operators.cuts import cut
from .binding import Tables, sql
from .catalogue import register
from .retrieval_queries import knowledge


def _rulings(t: Tables, k) -> DataFrame:
    """(ruling_id, text, host, number, status): an order's parts by name, the host first, between the rule that it cites and one that isn't there."""
    parts = t.t("lineitem").select(F.col("l_orderkey").alias("ruling_id"), F.col("l_partkey").alias("p")).join(k.cards.select(F.col("card_id").cast("long").alias("p"), "name"), "p")
    per = parts.groupBy("ruling_id").agg(F.array_sort(F.collect_set(F.struct("p", "name"))).alias("l"))
    said = F.array_join("l.name", " and the ")
    rows = per.join(k.cites, "ruling_id").join(t.t("orders").select(F.col("o_orderkey").alias("ruling_id"), F.col("o_orderstatus").alias("status")), "ruling_id")
    text = F.concat(F.lit("By rule "), "number", F.lit("  the "), said, F.lit(" meet, not by rule 999.1."))
    return rows.select("ruling_id", text.alias("text"), F.get("l", F.lit(0))["p"].cast("string").alias("host"), "number", "status")


def _modelled(rulings: DataFrame) -> DataFrame:
    """A model's candidates: by status a citation without a number, one with another number than it says, and one it isn't sure of."""
    f = F.col("status") == "F"
    o = F.col("status") == "O"
    start = F.when(o, 8).otherwise(0)
    end = F.when(o, 8 + F.length("number")).otherwise(2)
    other = F.when(F.col("number") == "100.0", "104.4").otherwise("100.0")
    return rulings.select(
        F.lit("CITES_RULE").alias("edge_type"), F.col("ruling_id").cast("string").alias("source_key"), F.when(o, other).otherwise(F.col("number")).alias("target_key"), start.alias("span_start"), end.alias("span_end"),
        F.when(o, F.col("number")).otherwise(F.lit("By")).alias("span_text"), F.when(f | o, "explicit").otherwise("llm").alias("method"), F.when(f | o, 0.9).otherwise(0.5).alias("confidence"),
    )


@register(
    "extraction_report",
    sql(
        "hosts rulings mentions cites",
        ", s AS (SELECT ruling_id, o_orderstatus AS status FROM cites JOIN hosts USING (ruling_id) JOIN orders ON o_orderkey = ruling_id) SELECT 'CITES_RULE' AS edge_type, 'accepted' AS outcome, count(*) AS n FROM s UNION ALL SELECT 'CITES_RULE', 'rule_not_in_graph', count(*) FROM s "
        "UNION ALL SELECT 'CITES_RULE', CASE status WHEN 'F' THEN 'citation_not_explicit' WHEN 'O' THEN 'explicit_number_disagrees' ELSE 'low_confidence' END, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'MENTIONS', 'accepted', count(*) FROM mentions JOIN s USING (ruling_id)",
    ),
)
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every candidate: links and stated numbers accepted, and each of the gate's reasons for citations."""
    t = Tables(spark, sf_dir)
    k = knowledge(t)
    rulings = cut(_rulings(t, k))
    _, report = extraction.extract(rulings.select("ruling_id", "text", "host"), k.lexicon, k.rules, k.cards, _modelled(rulings))
    return report
