"""The gate between proposed and stored edges: ordered checks, one reason for each rejection, duplicates folded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The types of edges, the ways in which candidates are found, and the least confidence.
EDGE_TYPES = ("MENTIONS", "CITES_RULE", "REFERENCES")
METHODS = ("exact", "loose", "surface", "explicit", "llm")
DETERMINISTIC = ("exact", "loose", "explicit")
MIN_CONFIDENCE = 0.7
#: Tasks over which the citations of one rule are dealt, and how many rules there may be for that.
DEALT, MOST_RULES = 32, 10_000


@dataclass(frozen=True)
class GatedFrame:
    """Judged candidates; only ``gate`` makes one, and only it can be loaded."""

    rows: DataFrame

    def accepted(self) -> DataFrame:
        return self.rows.where("reject_reason is null")

    def reject_counts(self) -> DataFrame:
        return self.rows.where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def gate(candidates: DataFrame, sources: DataFrame, known_rules: DataFrame, known_cards: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> GatedFrame:
    """Judge (ord, edge_type, source_key, target_key, span_start, span_end, span_text, method, confidence): the first check that fails names the reason.

    ``sources`` is (source_key, text), ``known_rules`` (number), ``known_cards`` (card_id as text).  Of accepted edges with the same type and
    ends the most confident stays (the first on ties); the others are duplicates.
    """
    # A source given twice is one source: its candidates stay single.
    texts = sources.groupBy("source_key").agg(F.min("text").alias("source_text")).withColumn("has_source", F.lit(True))
    # Both kinds of targets are one table and one join.  Candidates without a target would all meet in one task: they go by their source, under a mark that no key has.
    # Few rules (a job of its own counts them) are cited by very many: all but mentions, which need cards alone, are dealt by their source over copies of the rules.
    copies = DEALT if known_rules.limit(MOST_RULES + 1).count() <= MOST_RULES else 1
    known = known_rules.select(F.col("number").alias("_target"), F.lit(True).alias("is_rule"), F.lit(False).alias("is_card"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_deal"))
    known = known.unionByName(known_cards.select(F.col("card_id").cast("string").alias("_target"), F.lit(False).alias("is_rule"), F.lit(True).alias("is_card"), F.lit(0).alias("_deal")))
    deal = F.when(F.col("edge_type") == EDGE_TYPES[0], 0).otherwise(F.pmod(F.xxhash64("source_key"), F.lit(copies)).cast("int")).alias("_deal")
    known = known.where("_target is not null").groupBy("_target", "_deal").agg(F.max("is_rule").alias("is_rule"), F.max("is_card").alias("is_card"))
    meant = F.coalesce("target_key", F.concat(F.lit("\0"), F.coalesce("source_key", F.lit("")))).alias("_target")
    no = lambda x: F.coalesce(x, F.lit(False)) == F.lit(False)
    # Texts stay behind here: what follows exchanges only what was found in them.
    verbatim = F.expr("substring(source_text, span_start + 1, span_end - span_start)") == F.col("span_text")
    c = candidates.join(texts, "source_key", "left").select(*candidates.columns, "has_source", verbatim.alias("_verbatim"), meant, deal).join(known, ["_target", "_deal"], "left")
    c = c.withColumns({k: F.col(k) & F.col("target_key").isNotNull() for k in ("is_rule", "is_card")})
    number = F.regexp_extract("span_text", r"([0-9]{3}\.[0-9]+[a-z]?)", 1)
    mention, cite, ref = (F.col("edge_type") == t for t in EDGE_TYPES)
    in_schema = F.col("edge_type").isin(*EDGE_TYPES) & F.col("method").isin(*METHODS) & F.col("confidence").between(0, 1) & (F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start"))
    reason = F.coalesce(
        F.when(no(in_schema), "schema_invalid"),
        F.when(no(F.col("has_source")), "source_not_in_graph"),
        F.when(no(F.col("_verbatim")), "span_not_verbatim"),
        F.when(mention & F.col("target_key").isNull(), "mention_unresolved"),
        F.when(mention & no(F.col("is_card")), "card_not_in_graph"),
        F.when((cite | ref) & no(F.col("is_rule")), "rule_not_in_graph"),
        F.when(cite & (F.col("method") == "explicit") & (number == ""), "citation_not_explicit"),
        F.when(cite & (F.col("method") == "explicit") & (number != F.col("target_key")), "explicit_number_disagrees"),
        F.when(F.col("confidence") < min_confidence, "low_confidence"),
    )
    judged = c.withColumn("reject_reason", reason)
    w = Window.partitionBy(F.col("reject_reason").isNull(), "edge_type", "source_key", "target_key").orderBy(F.desc("confidence"), "ord")
    again = F.col("reject_reason").isNull() & (F.row_number().over(w) > 1)
    judged = judged.withColumn("reject_reason", F.when(again, "duplicate").otherwise(F.col("reject_reason")))
    return GatedFrame(judged.select(*candidates.columns, "reject_reason"))


def load_gated(gated: GatedFrame, version: str) -> DataFrame:
    """Accepted edges with their provenance, ready to be written by edge type."""
    if not isinstance(gated, GatedFrame):
        raise TypeError("only what the gate has judged can be loaded")
    source = F.when(F.col("method").isin(*DETERMINISTIC), "deterministic").otherwise("llm")
    return gated.accepted().drop("reject_reason").withColumns({"source": source, "extractor_version": F.lit(version)})
