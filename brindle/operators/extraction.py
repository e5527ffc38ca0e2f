"""The extraction pipeline: mentions and explicit citations of all rulings, judged by the gate, with a report of what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_spans, collapse_spaces
from . import linking
from .gate import GatedFrame, gate

_COLUMNS = ("edge_type", "source_key", "target_key", "span_start", "span_end", "span_text", "method", "confidence")


def mention_candidates(rulings: DataFrame, lex: DataFrame, host: DataFrame | str | None = None) -> DataFrame:
    """Candidates from links; a pending single word has no target and confidence 0.  Spans count characters of the text with single spaces."""
    at = linking.link_mentions(rulings, lex, "ruling_id", host=host)
    # A clause's punctuation behind the last word is no part of the name as it is said.
    said = F.regexp_replace("surface", r"[,.;:!?]+$", "")
    method = F.when(F.col("method") == "single", "surface").otherwise(F.col("method"))
    return at.select(
        F.lit("MENTIONS").alias("edge_type"), F.col("ruling_id").cast("string").alias("source_key"), F.col("id").cast("string").alias("target_key"), F.col("start").alias("span_start"),
        (F.col("start") + F.length(said)).cast("int").alias("span_end"), said.alias("span_text"), method.alias("method"), F.when(F.col("id").isNull(), 0.0).otherwise(1.0).alias("confidence"),
    )


def citation_candidates(rulings: DataFrame) -> DataFrame:
    """Candidates from rule numbers that texts state."""
    found = rulings.select("ruling_id", F.explode_outer(citation_spans(F.col("text"))).alias("c")).where("c is not null")
    return found.select(
        F.lit("CITES_RULE").alias("edge_type"), F.col("ruling_id").cast("string").alias("source_key"), F.col("c.number").alias("target_key"), F.col("c.start").alias("span_start"),
        F.col("c.end").alias("span_end"), F.col("c.number").alias("span_text"), F.lit("explicit").alias("method"), F.lit(1.0).alias("confidence"),
    )


def extract(rulings: DataFrame, lex: DataFrame, rules: DataFrame, cards: DataFrame, more: DataFrame | None = None) -> tuple[GatedFrame, DataFrame]:
    """The judged candidates of rulings (ruling_id, text, host), and (edge_type, outcome, n).

    Rulings are read three times, for links, for citations and by the gate: give them kept (:func:`cuts.cut`) where they are dear to make.
    ``more`` are candidates of other streams, such as a model's, in the gate's columns.
    """
    one = rulings.select("ruling_id", collapse_spaces(F.col("text")).alias("text"), "host")
    candidates = mention_candidates(one, lex, "host").unionByName(citation_candidates(one))
    if more is not None:
        candidates = candidates.unionByName(more.select(*_COLUMNS))
    # Order within a ruling is all the gate needs to choose among equals.
    candidates = candidates.withColumn("ord", F.col("span_start").cast("long"))
    gated = gate(candidates, one.select(F.col("ruling_id").cast("string").alias("source_key"), "text").where("text is not null"), rules, cards)
    outcome = F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    return gated, gated.rows.groupBy("edge_type", outcome).agg(F.count(F.lit(1)).alias("n"))
