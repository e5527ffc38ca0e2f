"""Moving citations from one version of a numbered text to the next: unchanged, edited, relocated or orphaned."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import collapse_spaces

SAME, MARGIN, BAND = 0.90, 0.15, 2
#: Characters in a gram of the candidate filter.
GRAM = 3


def similarity(a: str, b: str) -> float:
    """Share of matching characters, by longest matching blocks (in longer texts very frequent characters begin none)."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def _ratios(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(ratio=[similarity(a, b) for a, b in zip(f["was"], f["now"], strict=True)])


def with_ratio(pairs: DataFrame) -> DataFrame:
    """(.., was, now) with their similarity; Spark has no such function, so this runs on Arrow batches."""
    return pairs.mapInPandas(_ratios, ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", ratio double")


#: Characters that are counted one by one for the bound; all others count as one.
COUNTED = " etaoinsrhldcumfpgwybvk.,"


def character_counts(c: Column) -> Column:
    """How often a text has each of the counted characters, and how many others."""
    each = [F.length(c) - F.length(F.translate(c, x, "")) for x in COUNTED]
    return F.array(*each, F.length(F.translate(c, COUNTED, "")))


def _bound(a: str, b: str) -> Column:
    """No alignment of two texts matches more characters than both have of each kind."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def _grams(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, gram, pos): a text's runs of ``GRAM`` characters, each with the number of its occurrence, so that what two texts share is counted with repeats."""
    chars = F.split(F.col(text), "")
    chars = F.filter(chars, lambda c: c != "")
    rows = texts.select(key, F.length(text).alias("length"), chars.alias("_c"))
    n = F.greatest(F.size("_c") - (GRAM - 1), F.lit(0))
    run = F.slice("_c", F.lit(1), n)
    for k in range(1, GRAM):
        run = F.zip_with(run, F.slice("_c", F.lit(k + 1), n), lambda x, y: F.concat(x, y))
    rows = rows.select(key, "length", F.posexplode(run).alias("pos", "_g"))
    nth = F.row_number().over(Window.partitionBy(key, "_g").orderBy("pos"))
    return rows.select(key, "length", F.concat("_g", F.lit("#"), nth.cast("string")).alias("gram"), "pos")


def _rarest(grams: DataFrame, frequency: DataFrame, key: str) -> DataFrame:
    """The grams of each text that a text alike must share one of: the rarest 0.6 of its length and one."""
    ranked = grams.join(frequency, "gram", "left").withColumn("_f", F.coalesce("_f", F.lit(0)))
    n = F.row_number().over(Window.partitionBy(key).orderBy("_f", "gram"))
    return ranked.withColumn("_n", n).where(F.col("_n") <= F.floor(F.col("length") * 0.6) + 1).select(key, "length", "gram", "pos")


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct (number, target) of old (number, was) and new (target, now) texts within ``BAND`` chapters that can reach the threshold; none that does is missed.

    Texts whose ratio is ``SAME`` or more differ by at most (1 - SAME)(a + b) single characters taken out or put in, each of which breaks at most ``GRAM`` grams.  So they share 0.4 of the longer one's grams and more, and with all grams in one
    order, rare ones first, one of the first 0.6 of each.  Lengths, the places of the gram shared and counts of characters bound the rest.  Texts of at most 5 characters have no such gram and meet by chapter.
    """
    chapter = lambda c: F.split_part(c, F.lit("."), F.lit(1)).cast("int")
    band = F.explode(F.sequence(F.col("chapter") - BAND, F.col("chapter") + BAND))
    theirs = _grams(new, "target", "now")
    frequency = theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("_f"))
    a = _rarest(_grams(old, "number", "was"), frequency, "number").withColumn("chapter", chapter("number"))
    a = a.select("number", "gram", F.col("length").alias("la"), F.col("pos").alias("pa"), band.alias("chapter"))
    b = _rarest(theirs, frequency, "target").select("target", "gram", F.col("length").alias("lb"), F.col("pos").alias("pb"), chapter("target").alias("chapter"))
    slack = (1 - SAME) * (F.col("la") + F.col("lb")) + 1e-6
    met = a.join(b, ["gram", "chapter"]).where((F.abs(F.col("pa") - F.col("pb")) <= slack) & (F.abs(F.col("la") - F.col("lb")) <= slack) & (F.col("number") != F.col("target")))
    short = old.where(F.length("was") <= 5).select("number", chapter("number").alias("chapter")).select("number", band.alias("chapter"))
    brief = short.join(new.where(F.length("now") <= 7).select("target", chapter("target").alias("chapter")), "chapter").where("number <> target")
    return met.select("number", "target").unionByName(brief.select("number", "target")).distinct()


def judge(old: DataFrame, new: DataFrame) -> DataFrame:
    """(number, verdict, target, ratio) for each rule of ``old`` (number, text) against ``new`` (number, text).

    A number whose text stays is ``unchanged``.  Else the most alike rule within two chapters, of equals the first in order, takes its place (``relocated``) if it is alike enough and clearly more than what the number now says.  Else a number
    that is still there is ``edited``, and one that isn't, or had no text, ``orphaned``.  A number of a chapter alone is unchanged while the chapter has rules.  ``ratio`` is that of the text which counts, null where none does.
    """
    spaced = lambda df, name: df.select("number", collapse_spaces(F.coalesce("text", F.lit(""))).alias(name))
    n = spaced(new, "now")
    alone = old.where("not contains(number, '.')").select("number").join(n.where("contains(number, '.')").select(F.split_part("number", F.lit("."), F.lit(1)).alias("number")).distinct().withColumn("_there", F.lit(True)), "number", "left")
    none = F.lit(None)
    of_chapters = alone.select("number", F.when(F.col("_there"), "unchanged").otherwise("orphaned").alias("verdict"), F.when(F.col("_there"), F.col("number")).alias("target"), none.cast("double").alias("ratio"))
    o = spaced(old.where("contains(number, '.')"), "was")
    own = o.join(n, "number", "left").withColumn("there", F.col("now").isNotNull())
    own = with_ratio(own.select("number", "was", F.coalesce("now", F.lit("")).alias("now"), "there"))
    own = own.select("number", "was", "there", F.when(F.col("there"), F.col("ratio")).otherwise(F.lit(0.0)).alias("same"), (F.col("there") & (F.col("was") == F.col("now"))).alias("equal"))
    moved = own.where((F.col("same") <= 1 - MARGIN) & (F.col("was") != "") & ~F.col("equal")).select("number", "was", "same")
    there = n.where("now <> ''").select(F.col("number").alias("target"), "now")
    close = candidates(moved, there).join(moved, "number").join(there, "target")
    close = close.where(2 * _bound(character_counts(F.col("was")), character_counts(F.col("now"))) >= SAME * (F.length("was") + F.length("now")))
    found = with_ratio(close.select("number", "target", "was", "now", "same")).where((F.col("ratio") >= SAME) & (F.col("ratio") >= F.col("same") + MARGIN))
    place = [F.split_part("target", F.lit("."), F.lit(1)).cast("int"), F.regexp_extract("target", r"\.([0-9]+)", 1).cast("int"), F.col("target")]
    w = Window.partitionBy("number").orderBy(F.desc("ratio"), *place)
    best = found.withColumn("n", F.row_number().over(w)).where("n = 1").select("number", "target", "ratio")
    out = own.join(best, "number", "left")
    verdict = F.when(F.col("was") == "", "orphaned").when(F.col("equal"), "unchanged").when(F.col("target").isNotNull(), "relocated").when(F.col("there"), "edited").otherwise("orphaned")
    out = out.withColumn("verdict", verdict)
    target = F.when(F.col("verdict") == "relocated", F.col("target")).when(F.col("verdict") != "orphaned", F.col("number"))
    ratio = F.when(F.col("verdict") == "relocated", F.round("ratio", 6)).when(F.col("verdict") == "edited", F.round("same", 6))
    return out.select("number", "verdict", target.alias("target"), ratio.alias("ratio")).unionByName(of_chapters)


def citing(verdicts: DataFrame, citations: DataFrame) -> DataFrame:
    """(number, verdict, target, ratio, n_rulings, needs_review): verdicts of the numbers that citations (ruling_id, rule_number) hold; edited and orphaned ones need a look."""
    n = citations.groupBy(F.col("rule_number").alias("number")).agg(F.count_distinct("ruling_id").alias("n_rulings"))
    return verdicts.join(n, "number").withColumn("needs_review", F.col("verdict").isin("edited", "orphaned"))


def apply_moves(citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Citations (.., rule_number) with relocated numbers replaced, and the verdict of each."""
    v = verdicts.select(F.col("number").alias("rule_number"), "verdict", F.col("target").alias("_to"))
    out = citations.join(v, "rule_number", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))
    new = F.when(F.col("verdict") == "relocated", F.col("_to")).otherwise(F.col("rule_number"))
    return out.withColumn("rule_number", new).drop("_to")


def word_diff(a: str, b: str, context: int = 3) -> str:
    """A readable diff by words: ``[-gone-]`` and ``{+new+}``, long equal runs elided."""
    x, y, out = a.split(), b.split(), []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            run = x[i:j]
            out += run if len(run) <= 2 * context else [*run[:context], "...", *run[-context:]]
        else:
            out += ["[-" + " ".join(x[i:j]) + "-]"] * (i < j) + ["{+" + " ".join(y[k:m]) + "+}"] * (k < m)
    return " ".join(out)


@F.pandas_udf(StringType())
def _word_diffs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_diff(x or "", y or "") for x, y in zip(a, b, strict=True)])


def with_diff(pairs: DataFrame, was: str, now: str) -> DataFrame:
    """``pairs`` with a readable ``diff`` of two columns, for the rows that need a look."""
    return pairs.withColumn("diff", _word_diffs(F.col(was), F.col(now)))
