"""Audits of citations and labels: findings, canonical citation structs, authored rows, and the life of sufficiency labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_terms
from .evaluation import tree_hash

ERROR, REVIEW = "error", "review"


def findings(citations: DataFrame, rulings: DataFrame, rules: DataFrame) -> DataFrame:
    """(ruling_id, number, check, severity, n): what is wrong, or may be, with the citations (ruling_id, number) of rulings (ruling_id, text).

    ``duplicate``: cited more than once; ``chapter-level``: a chapter and not a rule; ``unresolvable``: no such rule; for review ``no-shared-vocabulary``: the rule shares no search term with a ruling that has some.  Each citation has at most one of the last three.
    """
    cited = citations.groupBy("ruling_id", "number").agg(F.count(F.lit(1)).alias("n"))
    twice = cited.where("n > 1").select("ruling_id", "number", F.lit("duplicate").alias("check"), F.lit(ERROR).alias("severity"), "n")
    known = rules.select("number", distinct_terms(F.col("text")).alias("_rule"), F.lit(True).alias("_known")).dropDuplicates(["number"])
    rows = cited.join(known, "number", "left").join(rulings.select("ruling_id", distinct_terms(F.coalesce("text", F.lit(""))).alias("_own")), "ruling_id", "left")
    apart = (F.size("_own") > 0) & ~F.arrays_overlap("_own", "_rule")
    check = F.when(F.col("number").rlike(r"^\d{3}$"), "chapter-level").when(F.col("_known").isNull(), "unresolvable").when(apart, "no-shared-vocabulary")
    single = rows.withColumn("check", check).where("check is not null")
    single = single.select("ruling_id", "number", "check", F.when(F.col("check") == "no-shared-vocabulary", REVIEW).otherwise(ERROR).alias("severity"), "n")
    return twice.unionByName(single)


CITATION = "array<struct<rule_number:string,start:int,end:int,quote:string>>"


def canonical_citations(cited: Column) -> Column:
    """Structs (rule_number, rule, start, end, quote, text) as (rule_number, start, end, quote): the number under either name, places only with a quote, rule texts left out."""
    def one(c):
        whole = (F.coalesce(c["quote"], F.lit("")) != "") & c["start"].isNotNull() & c["end"].isNotNull()
        keep = lambda x: F.when(whole, c[x])
        return F.struct(F.coalesce(F.nullif(c["rule_number"], F.lit("")), c["rule"]).alias("rule_number"), keep("start").alias("start"), keep("end").alias("end"), keep("quote").alias("quote"))

    return F.coalesce(F.transform(cited, one), F.array().cast(CITATION))


def citation_changes(rows: DataFrame, cited: str) -> DataFrame:
    """One row (entries, changed, texts_dropped): how many entries the canonical form rewrites, and how many carried a rule's text."""
    both = rows.select(F.arrays_zip(F.col(cited).alias("was"), canonical_citations(F.col(cited)).alias("now")).alias("z")).select(F.explode_outer("z").alias("e")).where("e is not null")
    was, now = F.col("e.was"), F.col("e.now")
    same = was["rule"].isNull() & was["text"].isNull()
    for c in ("rule_number", "start", "end", "quote"):
        same = same & was[c].eqNullSafe(now[c])
    return both.agg(F.count(F.lit(1)).alias("entries"), F.count_if(~same).alias("changed"), F.count_if(was["text"].isNotNull()).alias("texts_dropped"))


def authored(rows: DataFrame, cards: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (id, question, gold_entities, gold_cr_rules), checked: an entity or rule that isn't there, or a repeated id, fails and names it (jobs of their own)."""
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids given twice: {sorted(r['id'] for r in twice)}")
    for column, known, key in (("gold_entities", cards, "name"), ("gold_cr_rules", rules, "number")):
        lost = rows.select(F.explode(column).alias(key)).distinct().join(known.select(key), key, "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"{column}: unknown {sorted(r[key] for r in lost)}")
    return rows.withColumn("verified", F.lit(False))


def sufficiency_init(outcomes: DataFrame, counts: DataFrame) -> DataFrame:
    """(question_id, outcome, evidence, label, stale_label): a row to label for each retrieved question, with how much evidence (question_id, kept) it has."""
    n = counts.groupBy("question_id").agg(F.sum("kept").alias("evidence"))
    out = outcomes.select("question_id", "outcome").join(n, "question_id", "left").fillna(0, ["evidence"])
    return out.withColumns({"label": F.lit(None).cast("string"), "stale_label": F.lit(None).cast("string")})


def sufficiency_reopen(labels: DataFrame, reopened: DataFrame, answered: DataFrame) -> DataFrame:
    """Labels with those of the ``reopened`` questions (question_id) cleared; the others are kept and marked stale.

    A question whose answer (``answered``) somebody has read can't be labelled afresh: reopening it fails (a job of its own).
    """
    read = reopened.join(answered.select("question_id"), "question_id", "left_semi").limit(5).collect()
    if read:
        raise ValueError(f"answers were read already: {sorted(r['question_id'] for r in read)}")
    out = labels.join(reopened.select("question_id").distinct().withColumn("_r", F.lit(True)), "question_id", "left")
    label = F.when(F.col("_r").isNull(), F.col("label"))
    stale = F.when(F.col("_r").isNull(), F.col("label")).otherwise(F.col("stale_label"))
    return out.withColumns({"stale_label": stale, "label": label}).drop("_r")


def label_hash(labels: DataFrame) -> DataFrame:
    """One row (sha256) over all labels, whatever the rows' order, in two levels."""
    return tree_hash(labels.withColumn("_all", F.lit(0)), "_all", "question_id", "label").select("sha256")
