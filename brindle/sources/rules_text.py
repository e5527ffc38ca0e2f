"""Numbered-rules text: lines to a tree of rules and a glossary.

A file is read line by line and in splits, never as one value, and state is carried over lines by ``scan.running``, so no task holds a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_references, level_of, parent_number
from ..operators.scan import running

SECTION = r"^([1-9])\. (\S.*)$"
CHAPTER = r"^([0-9]{3})\. (\S.*)$"
RULE = r"^([0-9]{3}\.[0-9]+[a-z]?)\.? (\S.*)$"


EFFECTIVE = r"These rules are effective as of (.+?)\."


def read_lines(spark: SparkSession, path: str, ranges: int | None = None) -> DataFrame:
    """(doc, pos, line) of whole files: byte order mark and carriage returns removed, lines numbered in order.

    Lines of a split come in order within one task, so a line's place is the split's offset and the row's number.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("doc"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    out = running(lines, ["doc"], ["split", "row"], number="pos", ranges=ranges)
    return out.select("doc", F.col("pos").cast("int").alias("pos"), F.when(F.col("pos") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("line"))


def effective_dates(lines: DataFrame) -> DataFrame:
    """(doc, effective_date): what the first line that states it says; null without one."""
    said = F.regexp_extract("line", EFFECTIVE, 1)
    return lines.groupBy("doc").agg(F.min_by(said, F.when(said != "", F.col("pos"))).alias("effective_date"))


def with_parts(lines: DataFrame) -> DataFrame:
    """Lines with ``part``: ``rules``, ``glossary`` or null.  A document without rules, glossary or credits fails.

    The table of contents repeats headings, so the body begins at the last section heading before the first rule.  Landmarks are aggregates, one row for each document.
    """
    at = lambda cond: F.when(cond, F.col("pos"))
    line = F.trim("line")
    first = lines.groupBy("doc").agg(F.min(at(line.rlike(RULE))).alias("_rule"), F.max(at(line == "Glossary")).alias("glossary"), F.max(at(line == "Credits")).alias("credits"))
    body = lines.where(line.rlike(SECTION)).join(first, "doc").where("pos < _rule").groupBy("doc").agg(F.max("pos").alias("body"))
    marks = first.join(body, "doc", "left")
    whole = F.col("body").isNotNull() & F.col("glossary").isNotNull() & F.col("credits").isNotNull()
    pos = F.col("pos")
    part = (
        F.when(~whole, F.raise_error(F.lit("no rules, glossary or credits found")).cast("string"))
        .when((pos >= F.col("body")) & (pos < F.col("glossary")), "rules")
        .when((pos > F.col("glossary")) & (pos < F.col("credits")), "glossary")
    )
    return lines.join(marks, "doc").select("doc", "pos", "line", part.alias("part"))


def _known(rows: DataFrame, on: list[str], said: str, known: DataFrame) -> DataFrame:
    """(on..., refs): references of ``said`` to numbers that the document has, first seen first."""
    asked = rows.select("doc", *[c for c in on if c != "doc"], F.posexplode(extract_references(F.col(said))).alias("_i", "number"))
    held = asked.join(known, ["doc", "number"], "left_semi")
    return held.groupBy(*on).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "number"))), lambda x: x["number"]).alias("refs"))


def parse_rules(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc, pos, number, level, text, parent, section, examples, refs) in document order by ``pos``.

    Each line belongs to the last rule above it; a section heading ends that.  Examples are kept apart, other lines are joined to the text; both are looked through for references to other rules.
    """
    df = with_parts(lines).where("part = 'rules'").withColumn("line", F.trim(F.translate("line", "\u00a0", " "))).where("line <> ''")
    section, rule, chapter = (F.col("line").rlike(r) for r in (SECTION, RULE, CHAPTER))
    number = F.when(section, F.lit("")).when(rule, F.regexp_extract("line", RULE, 1)).when(chapter, F.regexp_extract("line", CHAPTER, 1))
    title = F.when(rule, F.regexp_extract("line", RULE, 2)).when(chapter, F.regexp_extract("line", CHAPTER, 2)).otherwise(F.col("line"))
    df = df.select("doc", "pos", "line", title.alias("body_text"), number.alias("own"), F.when(section, F.regexp_extract("line", SECTION, 2)).alias("heading"))
    df = running(df, ["doc"], ["pos"], lasts={"number": F.col("own"), "section": F.col("heading")}, ranges=ranges).where("number <> ''")
    entry = F.struct("pos", F.col("body_text").alias("t"))
    example = F.col("line").startswith("Example:")
    told = F.sort_array(F.collect_list(F.when(~example, entry)))
    shown = F.sort_array(F.collect_list(F.when(example, F.struct("pos", F.trim(F.regexp_replace("line", "^Example:", "")).alias("t")))))
    out = df.groupBy("doc", "number").agg(F.min("pos").alias("pos"), F.min_by("section", "pos").alias("section"), told.alias("a"), shown.alias("e"))
    text = F.array_join(F.transform("a", lambda x: x["t"]), " ")
    rules = out.select("doc", "pos", "number", level_of(F.col("number")).alias("level"), text.alias("text"), parent_number(F.col("number")).alias("parent"), "section", F.transform("e", lambda x: x["t"]).alias("examples"))
    spoken = rules.select("doc", F.col("number").alias("_n"), F.concat_ws(" ", "text", F.array_join("examples", " ")).alias("_said"))
    refs = _known(spoken, ["doc", "_n"], "_said", rules.select("doc", "number")).withColumnRenamed("_n", "number")
    none = F.array().cast("array<string>")
    return rules.join(refs, ["doc", "number"], "left").select(*rules.columns, F.array_except(F.coalesce("refs", none), F.array("number")).alias("refs"))


def parse_glossary(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc, pos, term, definition): blocks between blank lines; the first line is the term, one without more is dropped."""
    df = with_parts(lines).where("part = 'glossary'").withColumn("line", F.trim(F.translate("line", "\u00a0", " ")))
    df = running(df, ["doc"], ["pos"], sums={"block": F.when(F.col("line") == "", 1).otherwise(0)}, ranges=ranges).where("line <> ''")
    out = df.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    words = F.transform("l", lambda x: x["line"])
    rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    return out.select("doc", F.get("l", F.lit(0))["pos"].alias("pos"), F.get(words, F.lit(0)).alias("term"), rest.alias("definition")).where("definition <> ''")


def glossary_references(glossary: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, term, refs): the rules of its document that each definition names."""
    return _known(glossary, ["doc", "term"], "definition", rules.select("doc", "number"))


def keyword_definitions(glossary: DataFrame, chapters: tuple[str, ...] = ("701", "702")) -> DataFrame:
    """(keyword, number): glossary terms and the keyword rules that they name."""
    refs = glossary.select(F.lower("term").alias("keyword"), F.explode(extract_references(F.col("definition"))).alias("number"))
    return refs.where(F.split_part("number", F.lit("."), F.lit(1)).isin(*chapters)).distinct()
