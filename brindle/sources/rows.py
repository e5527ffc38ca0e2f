"""Row builders: parsed cards, rules, glossary entries and rulings as the rows of node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name, stable_id
from .records import faces, legality_edges
from .rules_text import keyword_definitions


def card_rows(cards: DataFrame) -> DataFrame:
    """Card nodes, with the name that they are looked up by."""
    return cards.select("oracle_id", "name", normalize_name(F.col("name")).alias("normalized_name"), "layout", "cmc", "type_line", "oracle_text", "mana_cost", "colors", "color_identity")


def face_rows(cards: DataFrame) -> DataFrame:
    return faces(cards).withColumn("normalized_name", normalize_name(F.col("name")))


def keyword_edges(cards: DataFrame) -> DataFrame:
    """(src, dst, display_name): a card's keywords by their normalised names, each once, with the first spelling that the card has."""
    rows = cards.select(F.col("oracle_id").alias("src"), F.posexplode("keywords").alias("i", "display_name")).withColumn("dst", normalize_name(F.col("display_name")))
    return rows.where("dst <> ''").groupBy("src", "dst").agg(F.min_by("display_name", "i").alias("display_name"))


def rule_rows(rules: DataFrame) -> DataFrame:
    return rules.select("number", "level", "text", "section", "examples", "pos")


def tree_edges(rules: DataFrame) -> DataFrame:
    """(src, dst) from a rule to each rule right below it."""
    return rules.where("parent is not null").select(F.col("parent").alias("src"), F.col("number").alias("dst"))


def reference_edges(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("number").alias("src"), F.explode("refs").alias("dst"))


def definition_edges(glossary: DataFrame) -> DataFrame:
    """(src, dst): keywords and the keyword rules that define them."""
    return keyword_definitions(glossary).select(normalize_name(F.col("keyword")).alias("src"), F.col("number").alias("dst")).distinct()


def ruling_rows(rulings: DataFrame) -> DataFrame:
    """(ruling_id, oracle_id, text, published_at, source) of rulings with a card; ids follow from the content, so equal rows are one ruling."""
    own = rulings.where("coalesce(oracle_id, '') <> ''")
    key = stable_id(F.col("oracle_id"), F.col("published_at"), F.col("source"), F.col("comment"))
    return own.select(key.alias("ruling_id"), "oracle_id", F.coalesce("comment", F.lit("")).alias("text"), "published_at", "source").dropDuplicates(["ruling_id"])


def card_tables(cards: DataFrame) -> dict[str, DataFrame]:
    edges = legality_edges(cards).select("src", "dst", F.lit("HAS_LEGALITY").alias("edge_type"), "status", F.lit(None).cast("string").alias("display_name"))
    words = keyword_edges(cards).select("src", "dst", F.lit("HAS_KEYWORD").alias("edge_type"), F.lit(None).cast("string").alias("status"), "display_name")
    return {"card": card_rows(cards), "face": face_rows(cards), "edge": edges.unionByName(words)}


def rule_tables(rules: DataFrame, glossary: DataFrame) -> dict[str, DataFrame]:
    none = [F.lit(None).cast("string").alias(c) for c in ("status", "display_name")]
    kinds = {"HAS_SUBRULE": tree_edges(rules), "REFERENCES": reference_edges(rules), "DEFINED_BY": definition_edges(glossary)}
    edges = None
    for kind, e in kinds.items():
        e = e.select("src", "dst", F.lit(kind).alias("edge_type"), *none)
        edges = e if edges is None else edges.unionByName(e)
    return {"rule": rule_rows(rules), "edge": edges}


def ruling_tables(rulings: DataFrame, cards: DataFrame) -> dict[str, DataFrame]:
    """Rulings of known cards and their edges; others aren't attached to anything and are left out."""
    rows = ruling_rows(rulings).join(cards.select("oracle_id").distinct(), "oracle_id", "left_semi").select("ruling_id", "oracle_id", "text", "published_at", "source")
    edges = rows.select(F.col("oracle_id").alias("src"), F.col("ruling_id").alias("dst"), F.lit("HAS_RULING").alias("edge_type"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("display_name"))
    return {"ruling": rows, "edge": edges}
