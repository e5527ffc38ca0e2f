"""Linking queries: texts made of the names of an order's parts, linked against the lexicon of all parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking as L
from .binding import Tables
from .catalogue import register

_NAME = "upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || p_partkey"
_DOCS = (
    f"parts AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS id, {_NAME} AS name, len(string_split(p_name, ' ')) + 1 AS width FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "placed AS (SELECT *, 1 + sum(width + 2) OVER (PARTITION BY doc ORDER BY id) - width - 2 AS pos, min(id) OVER (PARTITION BY doc) AS host FROM parts)"
)


def _names(t: Tables) -> DataFrame:
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" "), F.col("p_partkey").cast("string"))
    return t.t("part").select(name.alias("name"), F.col("p_partkey").alias("id"), F.upper("p_type").alias("kind"))


def _texts(t: Tables) -> DataFrame:
    """(doc, text, host): an order's part names in a sentence; the first part is the host."""
    parts = t.t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id")).join(_names(t).select("id", "name"), "id")
    per = parts.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("id", "name"))).alias("p"), F.min("id").alias("host"))
    said = F.array_join("p.name", " and the ")
    return per.select("doc", F.concat(F.lit("Does "), said, F.lit(", or does Tapping matter?")).alias("text"), "host")


@register(
    "link_mentions",
    f"WITH {_DOCS} SELECT doc, pos, width, 'exact' AS method, id, '' AS candidates FROM placed WHERE id <> host AND pos <> (SELECT max(pos) FROM placed p WHERE p.doc = placed.doc) "
    "UNION ALL SELECT doc, pos, width, 'loose', id, '' FROM placed WHERE id <> host AND pos = (SELECT max(pos) FROM placed p WHERE p.doc = placed.doc) "
    "UNION ALL SELECT doc, max(pos + width) + 2, 1, 'single', NULL, '-2;-1' FROM placed GROUP BY doc",
)
def link_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names but the host's, longest first though their ends are aliases too; one word that two cards are named by stays pending."""
    t = Tables(spark, sf_dir)
    names = _names(t)
    more = spark.createDataFrame([("Tapping", -1), ("tapping", -2), ("does", -3)], "name string, id long")
    aliases = names.select(F.expr("substring(name, instr(name, ' ') + 1)").alias("alias"), "id")
    docs = _texts(t)
    out = L.link_mentions(docs, L.lexicon(names.select("name", "id").unionByName(more), aliases), "doc", host="host")
    out = out.where("not (method = 'single' and array_contains(candidates, -3L))")
    return out.select("doc", F.col("at").cast("long").alias("pos"), F.col("width").cast("long").alias("width"), "method", "id", F.array_join("candidates", ";").alias("candidates"))


_ASKED = (
    f"q AS (SELECT p_partkey AS id, {_NAME} AS name, upper(p_type) || 'WALK' AS kw, CAST(len(string_split(p_name, ' ')) + 1 AS BIGINT) AS w, p_partkey % 3 = 0 AS lower_case, CASE WHEN p_partkey % 2 = 0 THEN '' || (100 + p_size) || '.4a' ELSE '' || (100 + p_size) END AS number FROM part)"
)


@register(
    "link_questions",
    f"WITH {_ASKED} SELECT id, 'rule' AS kind, CAST(2 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS width, number AS key, '' AS candidates FROM q UNION ALL SELECT id, 'format', w + 9, 2, 'House Rules', '' FROM q UNION ALL SELECT id, 'keyword', w + 5, 1, kw, '' FROM q "
    "UNION ALL SELECT id, 'card', 4, w, CASE WHEN NOT lower_case THEN CAST(id AS VARCHAR) END, CASE WHEN lower_case THEN CAST(id AS VARCHAR) ELSE '' END FROM q",
)
def link_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, formats, keywords and cards of a question for each part; where a question has no capitals its card is only a candidate."""
    t = Tables(spark, sf_dir)
    p = t.t("part")
    number = F.concat((F.col("p_size") + 100).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".4a").otherwise(""))
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" "), F.col("p_partkey").cast("string"))
    asked = F.concat(F.lit("Under rule "), number, F.lit(", is "), name, F.lit(" with "), F.upper("p_type"), F.lit("WALK, legal in the House Rules?"))
    # "is" and the name are parted from the rule by a comma, so the name begins at the fifth word; "the" is no part of the format's name.
    asked = F.when(F.col("p_partkey") % 3 == 0, F.lower(asked)).otherwise(asked)
    questions = p.select(F.col("p_partkey").alias("id"), asked.alias("question"))
    keywords = p.select(F.concat(F.upper("p_type"), F.lit("WALK")).alias("name")).distinct()
    formats = spark.createDataFrame([("House Rules",), ("Standard",)], "name string")
    out = L.link_questions(questions, L.lexicon(_names(t).select("name", "id")), keywords, formats, "id")
    return out.select("id", "kind", F.col("at").cast("long").alias("pos"), F.col("width").cast("long").alias("width"), "key", F.array_join("candidates", ";").alias("candidates"))
