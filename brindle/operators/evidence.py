"""Evidence sets: de-duplication, caps, token budgets, handles and fingerprints, all by question.

An evidence row is (question_id, arrival, kind, key, text, template, path, distance); ``arrival`` is its place in retrieval order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

# The bounds that results depend on, and the order of kinds in a context.
KIND_CAP = 25
TOKEN_BUDGET = 6000
KIND_ORDER = ("card", "keyword", "rule", "ruling", "legality")


def dedupe(evidence: DataFrame) -> DataFrame:
    """The first arrival of each (template, kind, key) of a question."""
    w = Window.partitionBy("question_id", "template", "kind", "key").orderBy("arrival")
    return evidence.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap(evidence: DataFrame, limit: int = KIND_CAP) -> DataFrame:
    """At most ``limit`` distinct items of a template and kind, first arrivals first."""
    w = Window.partitionBy("question_id", "template", "kind").orderBy("arrival")
    return dedupe(evidence).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def capped_counts(evidence: DataFrame, limit: int = KIND_CAP) -> DataFrame:
    """(question_id, kind, capped): rows whose item was not let in.

    An item that came again counts again, for only items that got in are remembered.
    """
    ident = ["question_id", "template", "kind", "key"]
    over = evidence.join(cap(evidence, limit).select(*ident), ident, "left_anti")
    return over.groupBy("question_id", "kind").agg(F.count(F.lit(1)).alias("capped"))


def budget(evidence: DataFrame, limit: int = TOKEN_BUDGET) -> DataFrame:
    """Rows left after evicting the farthest, then latest, until the rest fits: a row goes if without those
    before it in that order the total is still above ``limit``."""
    rows = evidence.withColumn("tokens", estimate_tokens(F.col("text")))
    q = Window.partitionBy("question_id")
    before = q.orderBy(F.desc("distance"), F.desc("arrival")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("tokens").over(q) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return rows.withColumn("_left", left).where(F.col("_left") <= limit).drop("_left")


def handles(evidence: DataFrame) -> DataFrame:
    """Citation handles: rulings are numbered in arrival order, other kinds are named by key, first arrival first."""
    w = Window.partitionBy("question_id", F.col("kind") == "ruling").orderBy("arrival")
    n = F.row_number().over(w)
    named = evidence.withColumn("handle", F.when(F.col("kind") == "ruling", F.concat(F.lit("ruling:"), n)).otherwise(F.concat("kind", F.lit(":"), "key")))
    first = Window.partitionBy("question_id", "handle").orderBy("arrival")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def serialize(evidence: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """(question_id, body): one text for each question, a heading for each kind in a fixed order, items as they came, each with the path that it came by.

    ``lost`` (question_id, n) counts what caps and budgets left out: its questions get a notice at the end, so a reader can hedge.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")), F.lit(0))
    line = F.concat(F.lit("["), "handle", F.lit("] "), "text", F.lit("\n    via "), "template", F.lit(": "), "path")
    entry = F.struct("arrival", line.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["line"])
    parts = handles(evidence).groupBy("question_id", "kind", rank.alias("rank")).agg(F.array_join(lines, "\n").alias("said"))
    part = F.struct("rank", F.concat(F.lit("## "), "kind", F.lit("\n"), "said").alias("said"))
    out = parts.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["said"]), "\n").alias("body"))
    if lost is None:
        return out
    left_out = lost.where("n > 0").groupBy("question_id").agg(F.sum("n").alias("_n"))
    notice = F.concat(F.lit("\n\nNOTICE: "), F.col("_n").cast("string"), F.lit(" further items did not fit here; name the gap where an answer rests on them."))
    return out.join(left_out, "question_id", "left").select("question_id", F.concat("body", F.coalesce(notice, F.lit(""))).alias("body"))


def fingerprint(evidence: DataFrame) -> DataFrame:
    """(question_id, sha256) over the rows in arrival order."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "key", "text", "template", "path", "distance")])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("arrival", row.alias("row")))), lambda x: x["row"])
    return evidence.groupBy("question_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def emit(rows: DataFrame, template: str, emits: list[dict]) -> DataFrame:
    """Template rows as evidence rows: each emit names kind, key, text and path expressions and perhaps an array to explode."""
    out = None
    for i, e in enumerate(emits):
        df = rows.withColumn("item", F.explode_outer(e["collection"])) if e.get("collection") else rows
        df = df.select(
            "question_id", F.col("row_no"), F.lit(i).alias("emit_no"), F.lit(e["kind"]).alias("kind"), F.expr(e["key"]).cast("string").alias("key"),
            F.expr(e["text"]).alias("text"), F.lit(template).alias("template"), F.expr(e["path"]).alias("path"), F.lit(e.get("distance", 0)).alias("distance"),
        ).where("key is not null and key <> ''")
        out = df if out is None else out.unionByName(df)
    w = Window.partitionBy("question_id").orderBy("row_no", "emit_no", "key")
    return out.withColumn("arrival", F.row_number().over(w).cast("long")).drop("row_no", "emit_no")
