"""Prompts and answers as DataFrames: grounding blocks, a prompt for each ruling, answers with their citations written out, and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import CITATION_BODY
from .graph import subtrees_by_label
from .stores import chapters, directory, write_json_lines

# How kinds of evidence are named where a citation is written out.
LABELS = {"card": "card", "keyword": "keyword", "rule": "CR", "ruling": "ruling", "legality": "legality"}
UNVERIFIED = "UNVERIFIED"
MAX_SUBRULES, SNIPPET = 6, 240


def _listing(rows: DataFrame, order: str) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct(order, F.concat_ws(" ", "number", F.trim("text")).alias("line"))))
    return rows.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("said"))


def grounding(rules: DataFrame, keyword_chapters: tuple[str, ...] = ("701", "702"), with_keywords: bool = True) -> DataFrame:
    """One row (block): what a model is told of the rules' structure, chapters first, then perhaps the keyword rules; bounded by the rules' headings."""
    whole = _listing(chapters(rules), "number").select(F.concat(F.lit("Chapters of the rules; cite the one that governs, which often is one of procedure and not of a keyword:\n"), "said").alias("block"))
    if not with_keywords:
        return whole
    words = _listing(directory(rules, keyword_chapters), "number").select(F.concat(F.lit("\n\nKeyword rules; a keyword is cited by one of these numbers or a lettered rule below it, and by no other:\n"), "said").alias("more"))
    return whole.select(F.concat("block", words.scalar()).alias("block"))


def candidate_rules(keyed: DataFrame, defined_by: DataFrame, labels: DataFrame, rules: DataFrame, most: int = MAX_SUBRULES, snippet: int = SNIPPET) -> DataFrame:
    """(owner, place, number, snippet): the rules behind an owner's keywords (owner, keyword, nth), each once, in order of keyword, defining rule and document.

    Each defining rule brings itself and its first ``most`` subrules; ``labels`` are its interval labels.  Subtrees are cut once for each rule, not for each owner.
    """
    heads = subtrees_by_label(labels, defined_by.select("number"))
    heads = heads.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("place"))).where(F.col("_n") <= most + 1).select("root", "number", F.col("place").alias("_place"))
    first = labels.select(F.col("number").alias("root"), F.col("enter").alias("_enter"))
    rows = keyed.join(defined_by.select("keyword", F.col("number").alias("root")), "keyword").join(first, "root").join(heads, "root")
    once = rows.groupBy("owner", "number").agg(F.min(F.struct("nth", "_enter", "_place")).alias("_at"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("_at", "number")))
    return placed.join(rules.select("number", F.substring("text", 1, snippet).alias("snippet")), "number").select("owner", "place", "number", "snippet")


def ruling_prompts(rulings: DataFrame, candidates: DataFrame, lead: str = "") -> DataFrame:
    """(ruling_id, prompt): a ruling (ruling_id, text) with the candidates (ruling_id, place, number, snippet) that its card's keywords give; without any the ruling alone."""
    line = F.struct("place", F.concat(F.lit("- "), "number", F.lit(": "), "snippet").alias("line"))
    told = candidates.groupBy("ruling_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("_c"))
    listed = F.concat(F.lit("Rules that may govern it (cite others only if you know that they exist):\n"), "_c")
    parts = [F.lit(lead) if lead else F.lit(None).cast("string"), listed, F.concat(F.lit('Ruling: "'), F.coalesce("text", F.lit("")), F.lit('"'))]
    return rulings.join(told, "ruling_id", "left").select("ruling_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def mention_prompts(pending: DataFrame, rulings: DataFrame) -> DataFrame:
    """(ruling_id, prompt): the pending mentions (ruling_id, start, surface, candidates) of a ruling, numbered in order of place, so that equal words stay apart."""
    nth = F.row_number().over(Window.partitionBy("ruling_id").orderBy("start", "surface"))
    said = F.concat(F.lit('"'), "surface", F.lit('" at '), F.col("start").cast("string"), F.lit(", may be "), F.array_join(F.transform("candidates", lambda c: F.substring(c.cast("string"), 1, 8)), ", "))
    rows = pending.withColumn("_n", nth).groupBy("ruling_id").agg(F.sort_array(F.collect_list(F.struct("_n", said.alias("s")))).alias("_l"))
    lines = F.array_join(F.transform("_l", lambda x: F.concat(x["_n"].cast("string"), F.lit(". "), x["s"])), "\n")
    return rulings.join(rows, "ruling_id").select("ruling_id", F.concat(F.lit('Ruling: "'), "text", F.lit('"\n\nWhich of these are cards:\n'), lines).alias("prompt"))


def written_out(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, text, unknown): answers (question_id, answer) with each marker replaced by what it stands for, and the handles that no evidence has, first seen first.

    ``evidence`` is (question_id, handle, kind, key, path).  A marker shows the paths of its handles, then each source, then what is unverified: a bad citation is neither dropped nor hidden.  An answer is cut at its markers, handles meet the
    evidence by a join, and the pieces are put together again in their order.
    """
    gaps, bodies = F.split("answer", CITATION_BODY), F.regexp_extract_all("answer", F.lit(CITATION_BODY), F.lit(1))
    marks = answers.where("answer is not null").select("question_id", F.posexplode(bodies).alias("m", "body"))
    handles = marks.select("question_id", "m", F.posexplode(F.transform(F.split("body", ";"), lambda h: F.trim(h))).alias("i", "handle")).where("handle <> ''")
    known = evidence.select("question_id", "handle", "kind", "key", "path").dropDuplicates(["question_id", "handle"]).withColumn("_known", F.lit(True))
    names = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)])
    rows = handles.join(known, ["question_id", "handle"], "left")
    have = F.col("_known").isNotNull()
    source = F.concat(F.lit("["), F.coalesce(F.try_element_at(names, F.col("kind")), F.col("kind")), F.lit(" "), "key", F.lit("]"))
    at = lambda c, what: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("i", what.alias("s"))))), lambda x: x["s"])
    shown = rows.groupBy("question_id", "m").agg(
        at(have & (F.coalesce("path", F.lit("")) != ""), F.col("path")).alias("paths"), at(have, source).alias("sources"), at(~have, F.concat(F.lit(f"[{UNVERIFIED} "), "handle", F.lit("]"))).alias("lost"),
    )
    path = F.when(F.size("paths") > 0, F.array(F.concat(F.lit("[path: "), F.array_join("paths", "; "), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    shown = shown.select("question_id", "m", F.array_join(F.concat(path, F.col("sources"), F.col("lost")), " ").alias("shown"))
    told = shown.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "shown"))).alias("_shown"))
    lost = rows.where(~have).groupBy("question_id", "handle").agg(F.min(F.struct("m", "i")).alias("_at"))
    lost = lost.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "handle"))), lambda x: x["handle"]).alias("unknown"))
    out = answers.join(told, "question_id", "left").join(lost, "question_id", "left")
    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(gaps) - 1, F.concat(g, F.coalesce(F.try_element_at("_shown", i), F.lit("")))).otherwise(g)), "")
    return out.select("question_id", F.when(F.col("answer").isNotNull(), F.when(F.size(bodies) > 0, rebuilt).otherwise(F.col("answer"))).alias("text"), F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))


def retrieval_records(questions: DataFrame, outcomes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, question, outcome, tokens, evidence): a record of each question's retrieval, its evidence rows in order of arrival; evidence is bounded by its caps."""
    row = F.struct("arrival", "kind", "key", "text", "template", "path", "distance")
    kept = evidence.groupBy("question_id").agg(F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(row)).alias("evidence"))
    out = questions.select("question_id", "question").join(outcomes.select("question_id", "outcome"), "question_id").join(kept, "question_id", "left")
    return out.fillna(0, ["tokens"]).withColumn("evidence", F.coalesce("evidence", F.array().cast(kept.schema["evidence"].dataType)))


def dump(records: DataFrame, path: str) -> None:
    """Records as JSON lines; a folder that is there already is not overwritten."""
    write_json_lines(records, path)
