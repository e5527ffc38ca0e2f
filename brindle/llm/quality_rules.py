"""Quality rules and a hashed n-gram log-likelihood ratio.  Native: no Python on executors.

Rule counts come first: words and their code points, symbols, repeated lines, and words in three-word windows that a text holds twice or more (windows are
told apart by 64-bit hashes of their words; only texts with a repeated one sort them).

The method compares two multinomials over ``BUCKETS`` hashed n-grams: the raw corpus (all texts) and the trusted target (texts with a label ``quality = 1``).  A text is cut into pieces,
maximal runs of letters, digits or marks; its n-grams are the pieces and the pairs of neighbours.  With counts c and totals N, P_raw(b) = (c_raw + 1) / (N_raw + BUCKETS) and
P_target(b) = (c_target + PRIOR * P_raw(b)) / (N_target + PRIOR): a bucket that the target hardly knows keeps the raw share.  A text's score is the mean over its n-grams of
ln P_target - ln P_raw (rounded to four places).  Every fifth target text, by the hash of its id, is held out of the target's counts; the threshold is the lowest score that keeps all but ``loss`` of the held-out
texts, scores rounded to thousandths, and every document is held against it: no draw decides.

Texts are read twice (counts, scores) and never shuffled: counts leave a task as one row a bucket.  The model is one array of ``BUCKETS`` doubles, whatever the input.
Labels are joined by broadcast where their checked size allows it.

Defined results: a null text counts as empty; a text without n-grams scores 0; without target texts, or none held out, the method keeps every document; a document with several labels is a target if one says so; a score
at the threshold is kept; repeated rows and ids stay repeated, a null id is no target; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, pick, small, written

BUCKETS = 16_384
PRIOR = float(BUCKETS)
HELD_OUT = 5
#: Words in a window whose repetition counts.
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
_PIECE = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D\x{80}-\x{10FFFF}]+"


def _next_to(values: Column, n: Column, step: int) -> Column:
    """The ``n`` values that stand ``step`` places on; none where ``n`` is negative."""
    return F.slice(values, F.lit(step + 1), F.greatest(n, F.lit(0)))


def rule_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(_WORD))
    rows = rows.withColumns({"_words": F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), "_lines": lines, "n_symbols": F.regexp_count(t, F.lit(_SYMBOL)).cast("long")})
    rows = rows.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda s, w: s + F.length(w))}).drop("_words")
    windows = F.size("_hashes") - (WINDOW - 1)
    run = _next_to(F.col("_hashes"), windows, 0)
    for k in range(1, WINDOW):
        run = F.zip_with(run, _next_to(F.col("_hashes"), windows, k), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumns({"n_words": F.size("_hashes").cast("long"), "_runs": run, "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_hashes", "_lines")
    # Sorted by hash, equal windows are neighbours; a text without any isn't sorted.
    placed = F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_runs")
    twice = F.zip_with("_placed", F.slice("_placed", F.lit(2), F.size("_placed")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))).drop("_placed")
    # A start covers its window, up to where the next one's begins.
    steps = F.zip_with("_starts", F.slice("_starts", F.lit(2), F.size("_starts")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long")).drop("_starts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def grams(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``_grams``: hashes of a text's pieces and of its pairs of neighbouring pieces."""
    rows = rows.withColumn("_p", F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_PIECE), F.lit(0)), lambda p: F.xxhash64(p)))
    n = F.size("_p") - 1
    pairs = F.zip_with(_next_to(F.col("_p"), n, 0), _next_to(F.col("_p"), n, 1), lambda a, b: F.xxhash64(a, b))
    return rows.withColumn("_grams", F.concat("_p", pairs)).drop("_p")


def bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def _targets(labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    """(id, fold): one row for each trusted document; fold 0 is held out."""
    good = labels.where(F.col(f"`{quality_col}`") == 1).select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct()
    return good.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)).cast("int"))


def model(texts: DataFrame) -> DataFrame:
    """(bucket, ratio) of ``texts`` (text, fold): every bucket of both multinomials; fold is null for a text that is no target."""
    # An outer explode: of an inner one Spark infers a filter on the array's size, which would cut and hash each text once more.
    counted = grams(texts).select((F.col("fold") > 0).alias("good"), F.explode_outer("_grams").alias("g")).where("g is not null")
    counts = counted.groupBy(bucket(F.col("g")).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    full = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    totals = full.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))  # one row
    raw = (F.col("raw") + 1.0) / (F.col("n_raw") + float(BUCKETS))
    target = (F.col("target") + PRIOR * raw) / (F.col("n_target") + PRIOR)
    return full.crossJoin(F.broadcast(totals)).select("bucket", F.when(F.col("n_target") > 0, F.round(F.log(target / raw), 4)).otherwise(F.lit(0.0)).alias("ratio"))


def threshold(held_out: DataFrame, loss: float) -> float | None:
    """The lowest ``score`` to keep so that at most ``loss`` of the rows lie below it; scores are thousandths, so a bounded number of values reaches the driver."""
    rows = held_out.groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy("score").collect()
    allowed, below = int(loss * sum(r["n"] for r in rows)), 0
    for r in rows:
        below += r["n"]
        if below > allowed:
            return r["score"]
    return None


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality", loss: float = 0.01,
) -> DataFrame:
    """One row per document: id, rule counts, base_failed, kept, score and the threshold used (null without one)."""
    base = pick(docs, id=id_col, text=text_col)
    targets = small(written(_targets(labels, label_id_col, quality_col)))
    texts = base.join(targets, "id", "left")
    ratios = written(model(texts))
    # A constant of the plan: BUCKETS numbers in bucket order, folded into one array before the scan begins.
    said = ratios.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).cast("array<string>"), ",")).first()[0]
    table = F.split(F.lit(said), ",").cast("array<double>")
    scored = grams(rule_counts(texts)).drop("text")
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.get(table, bucket(g)))
    score = F.when(F.size("_grams") > 0, F.round(total / F.size("_grams"), 3)).otherwise(F.lit(0.0))
    scored = written(scored.withColumn("score", score).drop("_grams"))
    cut = threshold(scored.where("fold = 0").select("score"), loss)
    discard(ratios)
    good = F.lit(True) if cut is None else F.col("score") >= F.lit(cut)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select(F.col("id").alias(id_col), *counts, "base_failed", (~F.col("base_failed") & good).alias("kept"), "score", F.lit(cut).cast("double").alias("threshold"))
