"""Reports over annotated, judged and accepted rows: confusions, mixes, progress, control comparisons, agreement, drawn samples.

All are aggregations with partial sums before the shuffle; what comes back has a row for each stratum, bucket or drawn item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rule_family
from .evaluation import draw, stratified_draw


def refusal_bucket(label: Column, refused: Column) -> Column:
    """One of five outcomes of a question with a sufficiency label; null for a label of another kind.

    On partial evidence both answers are right: they are counted and never scored.
    """
    return (
        F.when((label == "sufficient") & refused, "over_refusal").when(label == "sufficient", "answered")
        .when((label == "insufficient") & refused, "correct_refusal").when(label == "insufficient", "unsupported_answering")
        .when((label == "partial") & refused, "partial_refused").when(label == "partial", "partial_answered")
    )


def refusal_confusion(rows: DataFrame, label: str, refused: str) -> DataFrame:
    """(bucket, n, blocks): how many questions have each outcome, and whether any of them blocks a release."""
    bucket = refusal_bucket(F.col(label), F.col(refused)).alias("bucket")
    out = rows.select(bucket).where("bucket is not null and bucket <> 'answered'").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("blocks", F.col("bucket") == "over_refusal")


def cluster_flags(rows: DataFrame, cluster: str, order: str, flag: Column) -> DataFrame:
    """(cluster, flags): a cluster's flags as 0 and 1, in order; a cluster is one answer's judged sentences."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), flag.cast("int").cast("string").alias("f"))))
    return rows.groupBy(cluster).agg(F.array_join(F.transform(pairs, lambda x: x["f"]), "").alias("flags"))


def distribution(pairs: DataFrame, strata: DataFrame, doc: str, item: str, stratum: str, top: int = 5) -> DataFrame:
    """(section, key, n) of annotations: totals, items seen once, the most cited, how many a document has, and documents without any by stratum."""
    per_item = pairs.groupBy(F.col(item).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    per_doc = pairs.groupBy(doc).agg(F.count(F.lit(1)).alias("k"))
    row = lambda df, section, key, n: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    totals = per_item.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("n") == 1).alias("once"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("n")) for k in ("all", "distinct", "once")])).alias("r")
    out = row(totals.select(kinds), "total", F.col("r.k"), F.coalesce("r.n", F.lit(0)))
    out = out.unionByName(row(per_item.orderBy(F.desc("n"), "key").limit(top), "top", F.col("key"), F.col("n")))
    out = out.unionByName(row(per_doc.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "per_document", F.col("k"), F.col("n")))
    bare = strata.select(doc, stratum).join(per_doc.select(doc), doc, "left_anti").groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(row(bare, "uncited", F.col(stratum), F.col("n")))


def shares(rows: DataFrame, bucket: str, verdict: str) -> DataFrame:
    """(bucket, verdict, n, share): verdicts' shares within their bucket."""
    counts = rows.groupBy(bucket, verdict).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(bucket))
    return counts.withColumn("share", F.round(F.col("n") / whole, 6))


def probe_decision(rows: DataFrame, followed: Column, leaked: Column, floor: float = 0.80) -> DataFrame:
    """One row: probes, how many followed the graph, how many leaked, the upper bound of a rate never seen, and the decision."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(followed).alias("followed"), F.count_if(leaked).alias("leaks"))
    bound = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.round(3 / F.col("n"), 6))).otherwise(F.lit(1.0))
    return out.withColumns({"bound": bound, "passed": (F.col("n") > 0) & (F.col("followed") >= floor * F.col("n")) & (F.col("leaks") == 0)})


def cost_projection(rows: DataFrame, by: str, text: str, input_price: float, output_price: float, reply_tokens: int, corpus: int) -> DataFrame:
    """Cost of a sample's calls, per 1,000 rows and scaled to ``corpus`` rows; prices are for a million tokens."""
    tokens = F.sum(F.greatest(F.lit(1), F.floor(F.length(text) / 4)))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), tokens.cast("long").alias("input_tokens"))
    out = out.withColumn("output_tokens", F.col("n") * reply_tokens)
    usd = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000
    return out.withColumns({"usd_per_1000": F.round(usd / F.col("n") * 1000, 6), "usd_corpus": F.round(usd / F.col("n") * corpus, 4)})


def progress(rows: DataFrame, done: Column, *by: str) -> DataFrame:
    """Rows, finished rows and their share, for each group and (nulls) over all."""
    out = rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done"))
    return out.withColumn("share", F.round(F.col("done") / F.col("n"), 6)).select(*[F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in by], "n", "done", "share")


def family_mix(accepted: DataFrame, source: str, target: str, sources: DataFrame) -> DataFrame:
    """(family, n, share, covered): accepted targets by family, and the share of the sources that have any."""
    pairs = accepted.select(source, target).distinct()
    mix = pairs.groupBy(rule_family(F.col(target)).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    mix = mix.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row for each family
    flagged = sources.select(source).distinct().join(pairs.select(source).distinct().withColumn("hit", F.lit(1)), source, "left")
    covered = flagged.agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("covered")).scalar()
    return mix.withColumn("covered", covered)


def status_mix(rows: DataFrame, decided: str, seeded: str) -> DataFrame:
    """(status, seeded_n, decided_n, changed): how far decided labels moved from the seeded ones."""
    both = rows.select(F.explode(F.array(
        F.struct(F.col(seeded).alias("status"), F.lit(1).alias("s"), F.lit(0).alias("d"), F.lit(0).alias("c")),
        F.struct(F.col(decided).alias("status"), F.lit(0).alias("s"), F.lit(1).alias("d"), (F.col(decided) != F.col(seeded)).cast("int").alias("c")),
    )).alias("r")).select("r.*").where("status is not null")
    return both.groupBy("status").agg(F.sum("s").alias("seeded_n"), F.sum("d").alias("decided_n"), F.coalesce(F.sum("c"), F.lit(0)).alias("changed"))


def agreement(first: DataFrame, second: DataFrame, keys: list[str], label: str, collapse: dict[str, str]) -> DataFrame:
    """One row: pairs judged twice, exact agreement, and agreement after labels are taken together by ``collapse``."""
    a, b = first.select(*keys, F.col(label).alias("a")), second.select(*keys, F.col(label).alias("b"))
    grouped = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in collapse.items() for x in kv])[c], c) if collapse else c
    both = a.join(b, keys)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("exact"),
        F.round(F.avg((grouped(F.col("a")) == grouped(F.col("b"))).cast("int")), 6).alias("collapsed"),
    )


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last by ``order``: a later line supersedes an earlier one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def severity(c: Column, ranks: list[str]) -> Column:
    """Place of a status in a stated order; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ranks]), c), F.lit(0)), F.lit(len(ranks) + 1))


def shortages(counts: DataFrame, quotas: DataFrame, stratum: str, most: int) -> DataFrame:
    """(stratum, wanted, available, drawn, short) where a draw is bounded by the quota, by ``most`` and by what there is."""
    both = quotas.select(stratum, F.col("quota").alias("wanted")).join(counts.select(stratum, F.col("n_rows").alias("available")), stratum, "left")
    both = both.withColumn("available", F.coalesce("available", F.lit(0)))
    drawn = F.least("wanted", "available", F.lit(most))
    return both.select(stratum, "wanted", "available", drawn.alias("drawn"), (F.least("wanted", F.lit(most)) - drawn).alias("short"))


def mix_with_top_up(rows: DataFrame, mix: DataFrame, status: str, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows: each status's share of them by a seeded order, then the rest from what no share took.

    ``mix`` (status, quota) is a small table.  Only the first ``count`` rows of a status can be chosen, so no more are ranked together.
    """
    every = rows.select(status).distinct().select(status, F.lit(count).alias("quota"))
    held = stratified_draw(rows, every, status, key, seed)
    rank = F.row_number().over(Window.partitionBy(status).orderBy(draw(seed, key), key))
    held = held.withColumn("_rank", rank).join(mix, status, "left")
    extra = (F.col("_rank") > F.coalesce("quota", F.lit(0))).cast("int")
    return held.orderBy(extra, draw(seed, key), key).limit(count).drop("_rank", "quota")


def control_comparison(real: DataFrame, shuffled: DataFrame) -> DataFrame:
    """One row from two intervals (point, low, high): whether the real one lies above the control's."""
    a, b = real.select(F.struct("point", "low", "high").alias("r")), shuffled.select(F.struct("point", "low", "high").alias("s"))
    both = a.select("r", b.scalar().alias("s"))
    cols = [F.col(f"{x}.{c}").alias(f"{n}_{c}") for x, n in (("r", "real"), ("s", "control")) for c in ("point", "low", "high")]
    return both.select(*cols, (F.col("r.low") > F.col("s.high")).alias("separated"))


def drift(frozen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change) of frozen rows that are gone, changed or new, all columns compared."""
    cols = [c for c in frozen.columns if c != key]
    a = frozen.select(key, F.struct(*cols).alias("_a"))
    b = now.select(key, F.struct(*cols).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def disagreements(counts: DataFrame, doc: str, item: str, family: Column | None = None) -> DataFrame:
    """(doc, item, kind, depth_only): missed and wrong items; depth-only where the other kind has one of the same family in the document.

    Families with both kinds are found by a grouping, not by pairing items.
    """
    fam = rule_family(F.col(item)) if family is None else family
    rows = counts.where("g <> p").select(doc, item, F.when(F.col("g") == 1, "fn").otherwise("fp").alias("kind"), fam.alias("_family"))
    kinds = F.count_distinct("kind")
    both = rows.groupBy(doc, "_family").agg((kinds == 2).alias("depth_only"))
    return rows.join(both, [doc, "_family"]).select(doc, item, "kind", "depth_only")


def frozen_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows by a seeded digest: the same on every run."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def complement(vocabulary: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Entries of a closed vocabulary that nothing uses."""
    return vocabulary.select(key).distinct().join(used.select(key), key, "left_anti")


def not_subset(rows: DataFrame, items: str, allowed: Column) -> DataFrame:
    """Rows whose array holds an item that is not allowed, with those items."""
    return rows.withColumn("unknown", F.array_except(items, allowed)).where(F.size("unknown") > 0)


def upsert_counters(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: rows written, nodes created, deleted, and changed, from two snapshots."""
    cols = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(F.lit(1), *cols).alias("_a")).join(new.select(key, F.struct(F.lit(1), *cols).alias("_b")), key, "full_outer")
    return both.agg(
        F.count("_b").alias("rows"), F.count_if(F.col("_a").isNull()).alias("created"), F.count_if(F.col("_b").isNull()).alias("deleted"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).alias("changed"),
    )


def sufficiency_status(labels: DataFrame, by: str, label: str, floor: int) -> DataFrame:
    """(by, n, labelled, sufficient, enough): open labels and whether the sufficient ones reach the floor."""
    out = labels.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.count_if(F.col(label) == "sufficient").alias("sufficient"))
    return out.withColumn("enough", (F.col("labelled") == F.col("n")) & (F.col("sufficient") >= floor))
