"""Evaluation: precision and recall, resampling, paired tests, allocation, sampling, shuffled controls.

Random draws are ranks of MD5 digests of a seed and an id: the same on every engine, cluster and partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import paired_sign_test
from ..functions.text import rule_family
from .cuts import cut

#: Rows that one task groups, about, where they are dealt by their number.
MOST_ROWS = 500_000


def draw(seed: int, *cols: str) -> Column:
    """A repeatable random rank of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def pair_counts(gold: DataFrame, predicted: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item, g, p): each distinct item with whether gold and prediction hold it; documents without gold don't count."""
    g = gold.select(doc, item).distinct().withColumn("g", F.lit(1))
    p = predicted.select(doc, item).distinct().withColumn("p", F.lit(1)).join(gold.select(doc).distinct(), doc, "left_semi")
    return g.join(p, [doc, item], "full_outer").select(doc, item, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))


def _tally() -> list[Column]:
    g, p = F.col("g"), F.col("p")
    return [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("tp", g * p), ("fp", (1 - g) * p), ("fn", g * (1 - p)))]


def _ratios(tallied: DataFrame, *by: str) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return tallied.select(*by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def prf(counts: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn and micro precision, recall and F1 (0 on empty denominators), by the columns given."""
    return _ratios(counts.groupBy(*by).agg(*_tally()), *by)


def prf_by_stratum(counts: DataFrame, strata: DataFrame, doc: str, stratum: str) -> DataFrame:
    """Overall (stratum ``all``) and each stratum in one pass over grouping sets."""
    rows = counts.join(strata.select(doc, stratum).distinct(), doc, "left").withColumn(stratum, F.coalesce(stratum, F.lit("unstratified")))
    out = rows.rollup(stratum).agg(*_tally())
    return _ratios(out.withColumn(stratum, F.coalesce(stratum, F.lit("all"))), stratum)


def roll_up(items: DataFrame, doc: str, item: str) -> DataFrame:
    """Items as their rule families, distinct."""
    return items.select(doc, rule_family(F.col(item)).alias(item)).distinct()


@F.pandas_udf(DoubleType())
def _sign_test(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([paired_sign_test(int(x), int(y)) for x, y in zip(a, b, strict=True)])


def mcnemar(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by..., only_a, only_b, p_value): exact two-sided test on the discordant pairs; p = 1 without any.

    Pairs are counted in each task; the test sees one row for each group, and its memory doesn't grow with the pairs.
    """
    n = pairs.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    return n.select(*by, "only_a", "only_b", F.round(_sign_test("only_a", "only_b"), 6).alias("p_value"))


def retrieval_recall(gold: DataFrame, found: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, recall): the share of each document's gold items that was found; documents without gold have none to find and no row.

    Rows of both sides meet in one grouping instead of a join, and are dealt by their number (counted), so that a task holds about ``MOST_ROWS`` of them at any size.
    """
    named = F.col(doc).isNotNull() & F.col(item).isNotNull()
    both = gold.select(doc, item, F.lit(True).alias("_gold"), F.lit(False).alias("_hit")).unionByName(found.where(named).select(doc, item, F.lit(False).alias("_gold"), F.lit(True).alias("_hit")))
    parts = max(gold.sparkSession.sparkContext.defaultParallelism, math.ceil(both.count() / MOST_ROWS))
    rows = both.repartition(parts, doc, item).groupBy(doc, item).agg(F.max("_gold").alias("_gold"), F.max("_hit").alias("_hit")).where("_gold")
    return rows.select(doc, "_hit").repartition(parts, doc).groupBy(doc).agg((F.count_if("_hit") / F.count(F.lit(1))).alias("recall"))


def mean_by_stratum(rows: DataFrame, stratum: str, value: str) -> DataFrame:
    """(stratum, n, value): means over the rows that have one."""
    held = rows.where(F.col(value).isNotNull())
    return held.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias(value))


def hit_rates(asked: DataFrame, hits: DataFrame, key: str, stratum: str, *kinds: str) -> DataFrame:
    """(stratum, n, and for each kind its hits and rate), overall as ``all``: how many of the asked (key, stratum) have a hit of each kind (key and a 0 or 1 for each) in any row."""
    best = hits.groupBy(key).agg(*[F.max(k).alias(k) for k in kinds])
    rows = asked.select(key, stratum).join(best, key, "left").fillna(0, list(kinds))
    cols = [x for k in kinds for x in (F.sum(k).alias(f"{k}_hits"), F.round(F.avg(k), 6).alias(f"{k}_rate"))]
    out = rows.rollup(stratum).agg(F.count(F.lit(1)).alias("n"), *cols)
    return out.withColumn(stratum, F.coalesce(stratum, F.lit("all")))


def coverage(sentences: DataFrame, cluster: str, cited: str, factual: str, most_excluded: float = 0.20) -> DataFrame:
    """One row (cited, factual, excluded, segmented, clusters, answers, rate, void): how many factual sentences of answers carry a citation.

    The rate is null without factual sentences; the count is void where more than ``most_excluded`` of the sentences were left out as not factual.
    """
    f, c = F.coalesce(F.col(factual), F.lit(False)), F.coalesce(F.col(cited), F.lit(False))
    both, n_factual, n = F.count_if(f & c), F.count_if(f), F.count(F.lit(1))
    return sentences.agg(
        both.alias("cited"), n_factual.alias("factual"), F.count_if(~f).alias("excluded"), n.alias("segmented"), F.count_distinct(F.when(f, F.col(cluster))).alias("clusters"), F.count_distinct(cluster).alias("answers"),
        F.round(both / F.nullif(n_factual, F.lit(0)), 6).alias("rate"), (F.count_if(~f) / F.nullif(n, F.lit(0)) > most_excluded).alias("void"),
    )


def histogram(rows: DataFrame, code: str) -> DataFrame:
    """(code, n), the most frequent first, equal ones by code."""
    return rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), code)


def counts_of(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) for each of the given values, 0 for one without rows; other values don't count."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, column, "left").fillna(0, ["n"])


def rule_of_three(n: int) -> float:
    """Upper bound of a rate of which none was seen in ``n``."""
    return 3 / n if n else 1.0


def allocate(counts: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, quota) by largest remainders: ``n`` places in proportion to ``n_rows``, ties by name; all rows where n is no less."""
    one = Window.partitionBy(F.lit(1))
    total = F.sum("n_rows").over(one)
    share = F.col("n_rows") * n / total
    c = counts.withColumn("_t", total).withColumn("_base", F.floor(share).cast("long")).withColumn("_rest", F.round(share - F.floor(share), 9))
    rank = F.row_number().over(one.orderBy(F.desc("_rest"), stratum))
    extra = (rank <= n - F.sum("_base").over(one)).cast("long")
    return c.select(stratum, F.when(F.lit(n) >= F.col("_t"), F.col("n_rows")).otherwise(F.col("_base") + extra).alias("quota"))


def stratified_draw(rows: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: int, salts: int = 64) -> DataFrame:
    """The first ``quota`` rows of each stratum by a seeded digest.

    Each salted part of a stratum is ranked first and sends on no more than the quota, so a stratum of very many rows isn't sorted in one task.
    """
    order = [draw(seed, key), F.col(key)]
    part = F.pmod(F.xxhash64(key), F.lit(salts))
    held = rows.join(quotas, stratum).withColumn("_part", part)
    for keys in ([stratum, "_part"], [stratum]):
        held = held.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n <= quota").drop("_n")
    return held.drop("_part", "quota")


def derangement(rows: DataFrame, group: str, key: str, value: str, seed: int) -> DataFrame:
    """Each row of a group of two or more with the value of another: a cyclic shift along a seeded order."""
    w = Window.partitionBy(group).orderBy(draw(seed, key), key)
    whole = Window.partitionBy(group)
    other = F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("*", F.count(F.lit(1)).over(whole).alias("_n"), other.alias("shuffled")).where("_n > 1").drop("_n")


#: Upper bounds of a 32-bit draw for Poisson(1) counts of 0, 1, 2, ...
_POISSON = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12))


def _resampled(seed: int, resamples: int):
    """Rows (cluster, x) as one row (v) for each task: for every resample the sums of the clusters' ``x`` weighted by their Poisson(1) counts, and the number of clusters drawn.

    A count comes from the first 32 bits of the MD5 digest of seed, resample and cluster, the same on every engine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, total = np.array(_POISSON, np.uint64), None
        leads = [hashlib.md5(f"{seed}|{b}|".encode()) for b in range(resamples)]
        for batch in batches:
            x = np.stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])], 1)
            total = np.zeros((resamples, x.shape[1])) if total is None else total
            draws = np.empty(resamples, ">u4")
            for i, cluster in enumerate(batch.column(0).to_pylist()):
                own, parts = cluster.encode(), []
                for lead in leads:
                    h = lead.copy()
                    h.update(own)
                    parts.append(h.digest()[:4])
                draws[:] = np.frombuffer(b"".join(parts), ">u4")
                total += np.searchsorted(bounds, draws.astype(np.uint64), side="right")[:, None] * x[i]
        if total is not None:
            yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    return run


def bootstrap(clusters: DataFrame, key: str, sums: dict[str, Column], statistic: Callable[[dict[str, Column]], Column], resamples: int = 2000, seed: int = 13, alpha: float = 0.05) -> DataFrame:
    """(point, low, high): percentile interval of a statistic over resampled clusters, documents for example.

    ``statistic`` makes a column from the ``sums`` of columns over the clusters drawn: a mean, a ratio, an F1, a variance from moments.  Each cluster counts a Poisson(1) number of times in each resample, so clusters need neither ranks
    nor joins.  A task goes over its clusters once and sends on one vector of sums; vectors are added up by place, so no row is made for a cluster and a resample.  A resample without any cluster, or without a value, is left out.
    """
    names = list(sums)
    rows = clusters.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("cluster"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    vectors = rows.mapInArrow(_resampled(seed, resamples), "v array<double>")
    width = len(names) + 1
    cells = vectors.select(F.posexplode("v").alias("i", "x")).groupBy(F.floor(F.col("i") / width).alias("b"), (F.col("i") % width).alias("c")).agg(F.sum("x").alias("x"))
    each = cells.groupBy("b").agg(*[F.sum(F.when(F.col("c") == j, F.col("x"))).alias(n) for j, n in enumerate(["_drawn", *names])]).where("_drawn > 0")
    values = each.select(statistic({n: F.col(n) for n in names}).alias("v")).where("v is not null and not isnan(v)")
    out = values.agg(F.array_sort(F.collect_list("v")).alias("v"), F.count(F.lit(1)).alias("n"))
    at = lambda q: F.round(F.get("v", F.least(F.col("n") - 1, F.floor(q * F.col("n"))).cast("int")), 6)
    whole = clusters.agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    point = whole.select(F.round(statistic({n: F.col(n) for n in names}), 6).alias("point"))
    return out.select(point.scalar().alias("point"), at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def bootstrap_ratio(clusters: DataFrame, num: str, den: str, resamples: int = 2000, seed: int = 13, alpha: float = 0.05) -> DataFrame:
    """(point, low, high): percentile interval of sum(num) / sum(den) over resampled clusters (``cluster``, num, den)."""
    return bootstrap(clusters, "cluster", {"x": F.col(num), "y": F.col(den)}, lambda s: F.when(s["y"] != 0, s["x"] / s["y"]), resamples, seed, alpha)


def bootstrap_mean(documents: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 13, alpha: float = 0.05) -> DataFrame:
    """(point, low, high) of a statistic's mean over resampled documents."""
    rows = documents.select(F.col(key).alias("cluster"), F.col(value).alias("_x"), F.lit(1).alias("_y")).where("_x is not null")
    return bootstrap_ratio(rows, "_x", "_y", resamples, seed, alpha)


def frequency_table(df: DataFrame, col: str, top: int) -> DataFrame:
    """(value, n, share) of the most frequent values, ties by value."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.select("value", "n", F.round(F.col("n") / total, 6).alias("share")).orderBy(F.desc("n"), "value").limit(top)


def quantile_at(q: float) -> Callable[[Column], Column]:
    """Position min(n - 1, int(q n)) of n sorted values."""
    return lambda n: F.least(n - 1, F.floor(n * q))


def order_statistics(rows: DataFrame, by: str, value: str, places: dict[str, Callable[[Column], Column]], bins: int = 4096) -> DataFrame:
    """(by, n, and for each name the element at its place, from 0, of the group's sorted non-null values), exactly.

    Equal values become one row with their count, within each task first, so a value that most rows have is a sum and not a bin.  A wanted place is then found by refinement: the values between its bounds are counted into ``bins`` equal ranges, the range that holds the
    place gives the next bounds (the least and greatest value in it), until at most ``bins`` distinct values are left, whose counts are added up in order.  No task sorts more than ``bins`` rows of a group; rounds follow the logarithm of how unevenly values are spread.
    """
    bins = max(bins, 64)  # with few of them rounds would be many
    base = cut(rows.select(F.col(by).alias("_g"), F.col(value).alias("_v")).where("_v is not null").groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")))
    ends = base.groupBy("_g").agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("_total")).cast("long").alias("place")) for k, f in places.items()])
    cols = [F.col("_g").alias("_k"), "_name", "_place", "_before", "_lo", "_hi", "_d", "_total"]
    state = ends.withColumn("_w", F.explode(wanted)).withColumns({"_name": F.col("_w.name"), "_place": F.col("_w.place"), "_before": F.lit(0).cast("long")}).select(*cols)

    def between(s: DataFrame) -> DataFrame:
        return base.join(s, F.col("_g").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))

    state, even = cut(state), False
    while not state.where(F.col("_d") > bins).isEmpty():
        wide = state.where(F.col("_d") > bins)
        # Equal ranges part the least from the greatest value in each round; every other round goes by magnitude, so a tail over many of them is cut as fast.
        even, scale = not even, (lambda c: F.col(c).cast("double")) if not even else (lambda c: F.asinh(F.col(c).cast("double")))
        spread = scale("_hi") - scale("_lo")
        part = F.when(spread > 0, (scale("_v") - scale("_lo")) / spread).otherwise(F.lit(0.0))
        at = F.least(F.lit(bins - 1), F.floor(part * bins)).cast("int").alias("_bin")
        own = ["_g", "_name", "_place", "_before", "_total"]
        counts = between(wide).groupBy(*own, at).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_name").orderBy("_bin"))
        hit = counts.withColumn("_upto", upto).where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n")))
        hit = hit.withColumn("_before", F.col("_upto") - F.col("_n")).select(*cols)
        state = cut(state.where(F.col("_d") <= bins).unionByName(hit))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_name").orderBy("_v"))
    found = between(state).withColumn("_upto", upto).where(F.col("_upto") > F.col("_place"))
    found = found.groupBy("_g", "_name").agg(F.min("_v").alias("_v"), F.first("_total").alias("_total"))
    return found.groupBy(F.col("_g").alias(by)).agg(F.first("_total").alias("n"), *[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in places])


def set_hash(key: Column, value: Column) -> Column:
    """SHA-256 of ``key|value`` lines in order of the key, the same whatever the rows' order: for manifests and label sets; see ``tree_hash``."""
    lines = F.array_sort(F.collect_list(F.concat_ws("|", key.cast("string"), value.cast("string"))))
    return F.sha2(F.array_join(lines, "\n"), 256)


def tree_hash(rows: DataFrame, by: str, key: str, value: str, digits: int = 3) -> DataFrame:
    """(by, sha256): a set's hash in two levels, for sets too large to be put in order in one place.

    Lines are dealt by the first ``digits`` hexadecimal digits of their own digests; a part's digest is over its lines' sorted digests and
    the set's over its parts' in order.
    """
    own = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col(value).cast("string")), 256)
    lines = rows.select(by, own.alias("_d")).withColumn("_p", F.substring("_d", 1, digits))
    over = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = lines.groupBy(by, "_p").agg(over("_d").alias("_h")).select(by, F.concat_ws(":", "_p", "_h").alias("_h"))
    return parts.groupBy(by).agg(over("_h").alias("sha256"))
