"""Seeds by class, reachability against a walk, and generated questions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import generators as N
from brindle.operators import graph as G
from brindle.operators import reach as R


def test_entities_and_seeds(spark):
    defined = spark.createDataFrame([("flying", "702.9"), ("flying", "702.10"), ("reach", "702.17")], "keyword string, number string")
    cards = spark.createDataFrame([("Heron", "h"), ("Wall", "w"), ("Flying", "f"), ("Heron", "h2")], "name string, card_id string")
    words = spark.createDataFrame([("h", "reach"), ("h", "undefined"), ("f", "reach")], "card_id string, keyword string")
    e = spark.createDataFrame([(1, "FLYING"), (1, "Heron"), (2, "Wall"), (2, "Nobody"), (3, None), (4, "Heron"), (4, "Heron")], "question_id int, name string")
    got = R.resolved_entities(e, defined, cards, words)
    assert sorted((r["question_id"], r["name"] or "", r["how"]) for r in got.collect()) == [(1, "FLYING", "keyword"), (1, "Heron", "card_with_kw"), (2, "Nobody", "unknown"), (2, "Wall", "card_no_kw"), (3, "", "unknown"), (4, "Heron", "card_with_kw"), (4, "Heron", "card_with_kw")]
    assert sorted(tuple(r) for r in R.seed_rules(got, defined, words).collect()) == [(1, "702.10"), (1, "702.17"), (1, "702.9"), (4, "702.17")]
    assert sorted(tuple(r) for r in R.class_counts(got.where("question_id = 2")).collect()) == [("card_no_kw", 1), ("card_with_kw", 0), ("keyword", 0), ("unknown", 1)]


@pytest.mark.parametrize("hops", [0, 1, 3])
def test_reachability_against_a_walk(spark, hops):
    rng = random.Random(hops)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)}
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seeds = {q: {rng.randrange(40) for _ in range(rng.randrange(3))} for q in range(15)}
    gold = {q: {rng.randrange(40) for _ in range(3)} for q in range(15)}
    want: dict = {}
    for q in range(15):
        ball = set(seeds[q])
        for _ in range(hops):
            ball |= {y for x in ball for y in near.get(x, ())}
        s = want.setdefault(q % 2, [0, 0, 0, 0, []])
        s[0] += 1
        s[1] += len(gold[q] & ball)
        s[2] += len(gold[q])
        s[3] += not seeds[q]
        s[4].append(len(ball))
    adjacency = G.undirected(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string"))
    rows = lambda d: spark.createDataFrame([(q, str(n)) for q, ns in d.items() for n in ns], "question_id int, number string")
    questions = spark.createDataFrame([(q, str(q % 2)) for q in range(15)], "question_id int, stratum string")
    got = {r["stratum"]: tuple(r)[1:] for r in R.reachability(questions, rows(gold), rows(seeds), adjacency, hops).collect()}
    assert got == {str(k): (*s[:4], sorted(s[4])[len(s[4]) // 2]) for k, s in want.items()}


def test_ball_from_named_nodes_ends_early(spark):
    adjacency = G.undirected(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    got = G.ball(spark.createDataFrame([("q", "a"), ("q", "c"), ("r", "z")], "seed string, node string"), adjacency, 50)
    assert sorted(tuple(r) for r in got.collect()) == [("q", "a", 0), ("q", "b", 1), ("q", "c", 0), ("r", "z", 0)]


def test_generated_questions(spark):
    cards = spark.createDataFrame([(1, "Heron"), (2, None), (3, "")], "card_id int, name string")
    legal = spark.createDataFrame([(1, "Modern", "legal"), (1, "Old", "odd"), (2, "Modern", "legal"), (1, "New", None)], "card_id int, format string, status string")
    got = N.legality_questions(cards, legal, {"legal": "Yes, {name} in {format}."}).collect()
    assert [(r["id"], r["question"], r["answer"], r["gold_entities"], r["verified"]) for r in got] == [("legal-1-Modern", "Is Heron legal in Modern?", "Yes, Heron in Modern.", ["Heron"], True)]
    words = spark.createDataFrame([("First  Strike", "702.7", "It hits first."), ("Gone", "999.1", "x"), (" ", "702.7", "x")], "keyword string, number string, answer string")
    said = N.definition_questions(words, spark.createDataFrame([("702.7",)], "number string")).select("id", "question", "gold_entities", F.col("gold_cr_rules")[0]).collect()
    assert [tuple(r) for r in said] == [("define-first-strike", "What does first strike do?", ["First  Strike"], "702.7")]


def test_balls_are_put_together_once_for_a_set_of_seeds(spark):
    seeds = spark.createDataFrame([(q, n) for q in range(100) for n in ("b", "a")] + [(200, "a")], "question_id int, number string")
    balls = spark.createDataFrame([("a", "a"), ("a", "x"), ("b", "b"), ("b", "x")], "seed string, node string")
    sets = R.seed_sets(seeds)
    got = sorted((tuple(r["_seeds"]), r["number"]) for r in R.reached_from(sets, balls).collect())
    assert sets.count() == 101 and got == [(("a",), "a"), (("a",), "x"), (("a", "b"), "a"), (("a", "b"), "b"), (("a", "b"), "x")]
