"""How far questions reach: the rules that their entities land on, and what lies within some hops of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from .cuts import cut
from .evaluation import order_statistics
from .graph import ball

CLASSES = ("keyword", "card_with_kw", "card_no_kw", "unknown")


def resolved_entities(entities: DataFrame, defined_by: DataFrame, cards: DataFrame, card_keywords: DataFrame) -> DataFrame:
    """(question_id, name, how, card_id): what each entity (question_id, name) is: a defined keyword first, then a card with keywords or without, else unknown."""
    named = entities.withColumn("keyword", normalize_name(F.col("name")))
    words = defined_by.select("keyword").distinct().withColumn("_kw", F.lit(True))
    # Of cards with one name the first counts.
    own = cards.groupBy("name").agg(F.min("card_id").alias("card_id"))
    having = card_keywords.select("card_id").distinct().withColumn("_has", F.lit(True))
    rows = named.join(words, "keyword", "left").join(own, "name", "left").join(having, "card_id", "left")
    how = F.when(F.col("_kw"), "keyword").when(F.col("card_id").isNull(), "unknown").when(F.col("_has"), "card_with_kw").otherwise("card_no_kw")
    return rows.select("question_id", "name", "keyword", how.alias("how"), "card_id")


def seed_rules(resolved: DataFrame, defined_by: DataFrame, card_keywords: DataFrame) -> DataFrame:
    """(question_id, number): the rules that define a question's keywords, its own and those of its cards."""
    own = resolved.where("how = 'keyword'").select("question_id", "keyword")
    carded = resolved.where("how = 'card_with_kw'").select("question_id", "card_id").join(card_keywords, "card_id").select("question_id", "keyword")
    return own.unionByName(carded).distinct().join(defined_by.select("keyword", "number"), "keyword").select("question_id", "number").distinct()


def class_counts(resolved: DataFrame) -> DataFrame:
    """(how, n) for each of the four classes, 0 for one without entities."""
    every = resolved.sparkSession.createDataFrame([(c,) for c in CLASSES], "how string")
    return every.join(resolved.groupBy("how").agg(F.count(F.lit(1)).alias("n")), "how", "left").fillna(0, ["n"])


def seed_sets(seeds: DataFrame) -> DataFrame:
    """(question_id, _seeds): each question's seeds (question_id, number) as one sorted set."""
    return seeds.groupBy("question_id").agg(F.array_sort(F.collect_set("number")).alias("_seeds"))


def reached_from(sets: DataFrame, balls: DataFrame) -> DataFrame:
    """(_seeds, number): what lies in the balls (seed, node) of each distinct set, however many questions have it."""
    one = sets.select("_seeds").distinct()
    return one.select("_seeds", F.explode("_seeds").alias("seed")).join(balls.select("seed", "node"), "seed").select("_seeds", F.col("node").alias("number")).distinct()


def reachability(questions: DataFrame, gold: DataFrame, seeds: DataFrame, adjacency: DataFrame, hops: int) -> DataFrame:
    """(stratum, n, hit, total, no_seed, median_ball) of questions (question_id, stratum): how many of their gold rules (question_id, number) lie within ``hops`` of their seeds, and the upper median of what lies there.

    Balls are made once for each rule that is a seed, and put together once for each set of seeds, whatever the number of questions that land on it.  A question without a seed reaches nothing and counts in every column.
    """
    balls = ball(seeds.select(F.col("number").alias("seed")).distinct(), adjacency, hops)
    sets = seed_sets(seeds)
    reached = reached_from(sets, balls)
    sizes = reached.groupBy("_seeds").agg(F.count(F.lit(1)).alias("size"))
    seeded = sets.join(sizes, "_seeds").select("question_id", "size", F.lit(True).alias("_seeded"))
    wanted = gold.select("question_id", "number").distinct()
    # Inner joins: questions without seeds would all meet under one null.
    hits = wanted.join(sets, "question_id").join(reached, ["_seeds", "number"]).groupBy("question_id").agg(F.count(F.lit(1)).alias("hit"))
    totals = wanted.groupBy("question_id").agg(F.count(F.lit(1)).alias("total"))
    rows = questions.select("question_id", "stratum").join(seeded, "question_id", "left").join(hits, "question_id", "left").join(totals, "question_id", "left").fillna(0, ["size", "hit", "total"])
    rows = cut(rows.drop("question_id"))
    out = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hit"), F.sum("total").alias("total"), F.count_if(F.col("_seeded").isNull()).alias("no_seed"))
    middle = order_statistics(rows, "stratum", "size", {"median_ball": lambda n: F.floor(n / 2)}).select("stratum", "median_ball")
    return out.join(middle, out["stratum"].eqNullSafe(middle["stratum"])).select(out["stratum"], "n", "hit", "total", "no_seed", "median_ball")
