"""Skeleton rows from an API's payloads: JSON of no fixed schema, read as VARIANT, with lists whose elements differ in type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a cited rule's number may stand in an object, the first one that is set counts (fixed values of the payload).
NUMBER_FIELDS = ("ruleNumber", "number", "id")


def elements(v: Column, path: str) -> Column:
    """The list at a path as an array of variants; empty where there is none or something else stands there."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """The scalar at a path as text; null for none, an empty one, an object or a list."""
    at = F.to_json(F.try_variant_get(v, path, "variant"))
    said = F.try_variant_get(v, path, "string")
    return F.when(at.startswith("{") | at.startswith("["), F.lit(None)).otherwise(F.nullif(said, F.lit("")))


def names_of(v: Column, path: str, field: str = "name") -> Column:
    """A field of a list's objects, in order; elements without it are left out."""
    return F.filter(F.transform(elements(v, path), lambda x: _text(x, f"$.{field}")), lambda n: n.isNotNull())


def numbers_of(v: Column, path: str, fields: tuple[str, ...] = NUMBER_FIELDS) -> Column:
    """Rule numbers of a list that mixes texts and objects, in order; elements of other types, or without a number, are left out."""
    one = lambda x: F.when(_is(x, "STRING"), F.variant_get(x, "$", "string")).when(_is(x, "OBJECT"), F.coalesce(*[_text(x, f"$.{f}") for f in fields]))
    return F.filter(F.transform(elements(v, path), one), lambda n: n.isNotNull())


def skeletons(payloads: DataFrame, payload: str, source: str = "rg", content: tuple[str, ...] = ("question", "answer", "includedCards", "citedRules")) -> DataFrame:
    """(id, gold_entities, gold_cr_rules, url, snapshot_sha256, verified): an unverified row for each payload (JSON text) that is an object with an id.

    The snapshot's hash is over the ``content`` fields as canonical JSON (a variant's objects have their keys in order), so the order of keys and white space in a payload don't count.
    """
    # An exploded array of one: a filter on a plain column would be moved below it, and below any exchange, and parse each payload once more there.
    v = payloads.select(F.explode(F.array(F.try_parse_json(F.col(payload)))).alias("_v")).where("_v is not null")
    parts = [F.coalesce(F.to_json(F.try_variant_get("_v", f"$.{c}", "variant")), F.lit("null")) for c in content]
    key = _text(F.col("_v"), "$.id")
    rows = v.select(
        F.concat(F.lit(f"{source}-"), key).alias("id"), names_of(F.col("_v"), "$.includedCards").alias("gold_entities"), numbers_of(F.col("_v"), "$.citedRules").alias("gold_cr_rules"),
        _text(F.col("_v"), "$.url").alias("url"), F.sha2(F.concat_ws("\n", *parts), 256).alias("snapshot_sha256"), F.lit(False).alias("verified"),
    )
    return rows.where("id is not null")
