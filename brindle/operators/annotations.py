"""Keyed edits of annotated rows: update-joins with reports, citation edits, spans, worksheets and frozen labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import CITATION_BODY
from . import stores


def apply_keyed(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of the edit of their key."""
    cols = [c for c in edits.columns if c != key]
    new = edits.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in rows.columns])


def unmatched(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(key, side): edits without a row, and rows without an edit."""
    a = edits.select(key).distinct().join(rows.select(key), key, "left_anti").withColumn("side", F.lit("edit"))
    return a.unionByName(rows.select(key).distinct().join(edits.select(key), key, "left_anti").withColumn("side", F.lit("row")))


def add_citation(rows: DataFrame, key: str, at, column: str, number: str, known: DataFrame) -> DataFrame:
    """The row at a key with one more citation; an unknown number fails (a job of its own looks it up)."""
    if not known.where(F.col("number") == number).limit(1).count():
        raise ValueError(f"{number} is no known rule")
    return rows.withColumn(column, F.when(F.col(key) == at, F.array_union(column, F.array(F.lit(number)))).otherwise(F.col(column)))


def canonical(numbers: Column) -> Column:
    """Rule numbers without a trailing full stop and blanks, distinct, first seen first."""
    return F.array_distinct(F.transform(numbers, lambda n: F.regexp_replace(F.trim(n), r"\.$", "")))


def verbatim(text: Column, start: Column, end: Column, surface: Column) -> Column:
    """Whether a span's offsets hold its surface."""
    return F.coalesce(F.substring(text, start + 1, end - start) == surface, F.lit(False))


def mark_spans(text: Column, spans: Column, left: str = ">>", right: str = "<<") -> Column:
    """A text with marks around its (start, end) spans, set from the last to the first so that offsets hold."""
    ordered = F.reverse(F.array_sort(spans))
    put = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(left), F.substring(t, s["start"] + 1, s["end"] - s["start"]), F.lit(right), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(ordered, text, put)


def blind(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with an annotator's columns emptied for another pass."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def compare_passes(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """(key, first, second, agree) of two passes, null-safe; rows of one pass only disagree unless both are null."""
    both = a.select(key, F.col(column).alias("first")).join(b.select(key, F.col(column).alias("second")), key, "full_outer")
    return both.withColumn("agree", F.col("first").eqNullSafe(F.col("second")))


def require_done(rows: DataFrame, column: str) -> DataFrame:
    """``rows``, or an error while some have no value in ``column`` yet."""
    left = rows.where(F.col(column).isNull()).count()
    if left:
        raise ValueError(f"{left} rows have no {column} yet")
    return rows


def publishable(rows: DataFrame, valid: Column, key: str) -> DataFrame:
    """Verified rows in order of the key; refused if one of them isn't valid."""
    done = rows.where("verified")
    bad = [r[key] for r in done.where(~F.coalesce(valid, F.lit(False))).orderBy(key).select(key).limit(5).collect()]
    if bad:
        raise ValueError(f"not valid: {bad}")
    return done.orderBy(key)


def missing_needs(needs: Column, found: Column) -> Column:
    """What a question needs and was not retrieved."""
    return F.array_except(needs, F.coalesce(found, F.array().cast("array<string>")))


def vocabulary_overlap(items: DataFrame, group: str, item: str) -> DataFrame:
    """(item, groups): items that stand in more than one group, most first."""
    n = items.groupBy(item).agg(F.count_distinct(group).alias("groups")).where("groups > 1")
    return n.orderBy(F.desc("groups"), item)


# --- answers --------------------------------------------------------------------------------------------------------

_MARK = CITATION_BODY


def segment_answer(answer: Column) -> Column:
    """Sentences of an answer as (sentence, cited, handles): markers stay with the sentence before them."""
    joined = F.regexp_replace(answer, r"([.!?])(\s*(?:\[[a-z_]+:[^\]]+\]\s*)+)", "$2$1 ")
    parts = F.filter(F.split(F.trim(joined), r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"), lambda s: s != "")

    def one(s):
        bodies = F.regexp_extract_all(s, F.lit(_MARK), F.lit(1))
        handles = F.array_distinct(F.flatten(F.transform(bodies, lambda b: F.transform(F.split(b, ";"), lambda x: F.trim(x)))))
        plain = F.trim(F.regexp_replace(F.regexp_replace(s, _MARK, ""), r"\s+([.,;:!?])", "$1"))
        return F.struct(plain.alias("sentence"), (F.size(handles) > 0).alias("cited"), handles.alias("handles"))

    return F.transform(parts, one)


def expand_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, handle, shown, known): every handle of the answers (question_id, answer) with the path it stands for, or marked unverified."""
    bodies = F.regexp_extract_all("answer", F.lit(_MARK), F.lit(1))
    handles = F.array_distinct(F.flatten(F.transform(bodies, lambda b: F.transform(F.split(b, ";"), lambda x: F.trim(x)))))
    cited = answers.select("question_id", F.explode(handles).alias("handle"))
    out = cited.join(evidence.select("question_id", "handle", "path"), ["question_id", "handle"], "left")
    shown = F.when(F.col("path").isNull(), F.concat(F.lit("[UNVERIFIED "), "handle", F.lit("]"))).otherwise(F.concat(F.lit("[path: "), "path", F.lit("]")))
    return out.select("question_id", "handle", shown.alias("shown"), F.col("path").isNotNull().alias("known"))


# --- fixtures -------------------------------------------------------------------------------------------------------


def load_tagged(nodes: DataFrame, fixture: DataFrame, key: str, tag: str) -> DataFrame:
    """Nodes with a fixture's rows added under a tag; a key that is taken fails, for adopting a node would later delete it."""
    return stores.load_tagged(nodes, fixture, key, "tag", tag)


def teardown(nodes: DataFrame, tag: str) -> DataFrame:
    return stores.teardown(nodes, "tag", tag)
