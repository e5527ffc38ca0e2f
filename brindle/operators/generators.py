"""Golden questions made from the graph: legality of cards in formats, definitions of keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name

SOURCES = {"legality": "cards", "definition": "authored"}


def _sha(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols]), 256)


def legality_questions(cards: DataFrame, legalities: DataFrame, answers: dict[str, str]) -> DataFrame:
    """(id, stratum, hops, question, answer, gold_entities, gold_path, snapshot_sha256, verified) for each card (card_id, name) and format (card_id, format, status); a status without an answer, or a card without a name, has none.

    ``answers`` are sentences by status with ``{name}`` and ``{format}``.
    """
    rows = cards.where("coalesce(name, '') <> ''").select("card_id", "name").join(legalities.where(F.col("status").isin(*answers)), "card_id")
    said = F.lit(None).cast("string")
    for status, text in answers.items():
        said = F.when(F.col("status") == status, F.replace(F.replace(F.lit(text), F.lit("{name}"), F.col("name")), F.lit("{format}"), F.col("format"))).otherwise(said)
    card = F.col("card_id").cast("string")
    return rows.select(
        F.concat_ws("-", F.lit("legal"), card, "format").alias("id"), F.lit("legality_1hop").alias("stratum"), F.lit(1).alias("hops"), F.concat(F.lit("Is "), "name", F.lit(" legal in "), "format", F.lit("?")).alias("question"), said.alias("answer"),
        F.array("name").alias("gold_entities"), F.concat(F.lit("card "), card, F.lit(" > "), "status", F.lit(" in "), "format").alias("gold_path"), _sha(card, F.col("format"), F.col("status")).alias("snapshot_sha256"), F.lit(True).alias("verified"),
    )


def definition_questions(keywords: DataFrame, rules: DataFrame) -> DataFrame:
    """The same columns and ``gold_cr_rules`` for keywords (keyword, number, answer) whose rule is there; answers are somebody's own words."""
    key = normalize_name(F.col("keyword"))
    rows = keywords.join(rules.select("number"), "number", "left_semi").withColumn("_k", key).where("_k <> ''")
    return rows.select(
        F.concat(F.lit("define-"), F.replace("_k", F.lit(" "), F.lit("-"))).alias("id"), F.lit("definition_1hop").alias("stratum"), F.lit(1).alias("hops"), F.concat(F.lit("What does "), "_k", F.lit(" do?")).alias("question"), "answer",
        F.array("keyword").alias("gold_entities"), F.array("number").alias("gold_cr_rules"), F.concat(F.lit("keyword "), "_k", F.lit(" > rule "), "number").alias("gold_path"), _sha(F.col("_k"), F.col("number"), F.col("answer")).alias("snapshot_sha256"), F.lit(True).alias("verified"),
    )
