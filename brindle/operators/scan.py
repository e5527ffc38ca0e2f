"""Running values over ordered rows without a task that holds a whole group.

A window over a group sorts all of it in one task.  Here rows are dealt by key and order into ranges, values run within each range, and a summary of each range is carried to the ranges behind it: two passes
over the rows and one window over the summaries, of which a group has at most one for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, number: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with running values in ``order`` within ``keys``, the row itself included.

    ``sums`` adds up numbers (null counts nothing), ``lasts`` carries the last value that isn't null forward, ``number`` numbers rows from 0.  Nulls in ``order`` come first; rows that are equal in ``order`` follow one another somehow.  The rows are dealt once into ``ranges``
    (by default the session's number of shuffle partitions) and kept, which is a job of its own, so both passes see the same ranges.
    """
    spark = df.sparkSession
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if number is not None:
        sums[number] = F.lit(1).cast("long")
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    named = df.withColumns({f"_v_{c}": v for c, v in {**sums, **lasts}.items()}).withColumn("_row", F.monotonically_increasing_id())
    by = [*[F.col(o).asc_nulls_first() for o in order], F.col("_row")]
    dealt = cut(named.repartitionByRange(n, *keys, *by).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_s_{c}": F.sum(f"_v_{c}").over(own) for c in sums} | {f"_s_{c}": F.last(f"_v_{c}", ignorenulls=True).over(own) for c in lasts}
    at = F.struct(*[F.col(o).isNotNull() for o in order], *order, "_row")
    totals = [F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums] + [F.max_by(f"_v_{c}", F.when(F.col(f"_v_{c}").isNotNull(), at)).alias(f"_t_{c}") for c in lasts]
    parts = dealt.groupBy(*keys, "_range").agg(*(totals or [F.count(F.lit(1)).alias("_t")]))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_t_{c}").over(before).alias(f"_c_{c}") for c in sums] + [F.last(f"_t_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in lasts]
    parts = parts.select(*keys, "_range", *carried)
    rows = dealt.withColumns(local)
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[f"_c_{c}" for c in (*sums, *lasts)])
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = rows.join(parts, on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {c: zero(f"_c_{c}") + zero(f"_s_{c}") for c in sums} | {c: F.coalesce(f"_s_{c}", f"_c_{c}") for c in lasts}
    if number is not None:
        out[number] = out[number] - 1
    return rows.withColumns(out).select(*df.columns, *out)
