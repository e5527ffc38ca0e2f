"""Retrieval end to end: each outcome, the order of evidence, bounds, the last resort, and hubs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.operators import linking, retrieval, router
from brindle.operators import search as S


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def known(spark):
    cards = [("a", "Grey Heron", "flying lifts it over walls"), ("b", "Stone Wall", "it blocks; loses all powers"), ("c", "Old Oak", "powers of trees"), ("d", "Old Elm", "")]
    names = [(n, i) for i, n, _ in cards] + [("Old Yew", "e1"), ("Old Yew", "e2")]
    rules = [("702", None, 1, "Keywords", 0), ("702.9", "702", 2, "Flying", 1), ("702.9a", "702.9", 3, "A flyer is hard to block.", 2), ("702.9b", "702.9", 3, "See rule 613.4.", 3), ("613", None, 1, "Layers", 4), ("613.4", "613", 2, "An object that loses all powers", 5), ("613.41", "613", 2, "Another rule", 6)]
    return retrieval.Knowledge(
        cards=table(spark, cards, "card_id string, name string, text string"),
        card_keywords=table(spark, [("a", "flying")], "card_id string, keyword string"), keywords=table(spark, [("flying", "In the air."), ("reach", "Up to it.")], "keyword string, text string"),
        defined_by=table(spark, [("flying", "702.9")], "keyword string, number string"), legalities=table(spark, [("b", "Modern", "banned"), ("b", "Old School", "legal")], "card_id string, format string, status string"),
        rulings=table(spark, [(f"r{i}", "a", f"ruling {i}", f"2020-01-{i % 28 + 1:02d}") for i in range(60)] + [("x", "b", "about the heron", "2021-01-01")], "ruling_id string, card_id string, text string, published_at string"),
        cites=table(spark, [("x", "613.4")], "ruling_id string, number string"), mentions=table(spark, [("x", "a")], "ruling_id string, card_id string"),
        rules=table(spark, rules, "number string, parent string, level int, text string, pos long"), references=table(spark, [("702.9b", "613.4")], "src string, dst string"),
        formats=table(spark, [("Modern",), ("Old School",)], "name string"), lexicon=linking.lexicon(table(spark, names, "name string, id string")),
    )


ASKED = [
    (1, "Can Grey Heron be blocked?"), (2, "can grey heron be blocked?"), (3, "Why is that so?"), (4, "Is Stone Wall legal in Modern?"), (5, "What does rule 613.4 say, and rule 702.9b?"), (6, "What does flying mean?"),
    (7, "What does Old Oak do with powers?"), (8, "Does Stone Wall stop Grey Heron?"), (9, "What says rule 999.1?"), (10, "How do Old Yew trees grow?"), (11, "What does reach do?"), (12, "Old Elm"),
]


@pytest.fixture(scope="module")
def asked(spark):
    return table(spark, ASKED, "question_id long, question string")


def test_outcomes_and_routes(spark, known, asked):
    got = retrieval.retrieve(asked, known)
    have = {r["question_id"]: (r["outcome"], r["route"]) for r in got.outcomes.collect()}
    ok = router.RESOLVED
    assert have == {
        1: (ok, "graph"), 2: (router.AMBIGUOUS, None), 3: (router.NO_ENTITIES, None), 4: (ok, "legality"), 5: (ok, "graph"), 6: (ok, "graph"), 7: (ok, "text_search"), 8: (ok, "graph"), 9: (router.NO_MATCH, "graph"),
        10: (router.AMBIGUOUS, None), 11: (ok, "graph"), 12: (ok, "text_search"),
    }
    said = {r["question_id"]: r["account"] for r in retrieval.explain(got).collect()}
    assert said[3].startswith("outcome: no_entities by nothing") and "card_legality legality: 1 of 1" in said[4]


def evidence(got, q):
    rows = got.evidence.where(F.col("question_id") == q).orderBy("arrival").collect()
    return [(r["template"], r["kind"], r["key"], r["distance"]) for r in rows]


def test_evidence_is_in_order_and_bounded(known, asked):
    got = retrieval.retrieve(asked, known)
    one = evidence(got, 1)
    assert one[:5] == [("card_core", "card", "Grey Heron", 0), ("card_keyword_rules", "keyword", "flying", 1), ("card_keyword_rules", "rule", "702.9", 2), ("card_keyword_rules", "rule", "702.9a", 3), ("card_keyword_rules", "rule", "702.9b", 3)]
    assert len([x for x in one if x[1] == "ruling"]) == 25 and one[5][2] == "r27"  # the latest first
    assert evidence(got, 5)[:4] == [("rule_subtree", "rule", "613.4", 0), ("rule_neighbourhood", "rule", "613.4", 0), ("rule_neighbourhood", "rule", "702.9b", 1), ("rule_subtree", "rule", "702.9b", 0)]
    assert ("card_interaction", "ruling", "x", 1) in evidence(got, 8) and ("card_rulings", "rule", "613.4", 2) in evidence(got, 8)
    assert evidence(got, 4) == [("card_core", "card", "Stone Wall", 0), ("card_rulings", "ruling", "x", 1), ("card_rulings", "rule", "613.4", 2), ("card_legality", "legality", "Modern", 0)]
    assert ("text_search", "rule", "613.4", 1) in evidence(got, 7) and evidence(got, 11) == [("keyword_definition", "keyword", "reach", 0)]
    counts = {(r["question_id"], r["template"], r["kind"]): (r["found"], r["kept"]) for r in got.counts.collect()}
    assert counts[1, "card_rulings", "ruling"] == (50, 25)
    small = retrieval.retrieve(asked, known, kind_cap=2, token_budget=12)
    assert all(r["n"] <= 12 for r in small.evidence.groupBy("question_id").agg(F.sum("tokens").alias("n")).collect())
    assert ("card_core", "card", "Grey Heron", 0) in evidence(small, 1)


def test_without_text_search_and_with_a_last_resort(spark, known, asked):
    def last(failed):
        assert set(failed.columns) == {"question_id", "question", "outcome"}
        hit = failed.where("question_id in (2, 9)")
        return hit.select("question_id", F.lit(1).alias("item_no"), F.lit("card").alias("kind"), F.lit("K").alias("key"), F.lit("t").alias("text"), F.lit("p").alias("path"), F.lit(1).alias("distance"))

    got = retrieval.retrieve(asked, known, text_search=False, last_resort=last)
    have = {r["question_id"]: (r["outcome"], r["fallback"]) for r in got.outcomes.collect()}
    assert have[2] == have[9] == (router.RESOLVED, True) and have[10] == (router.AMBIGUOUS, False)
    # Cards are found, but nothing was set up that reaches rules from them.
    assert have[7] == have[12] == (router.NO_SEED, False)
    assert evidence(got, 9) == [("last_resort", "card", "K", 1)]


def test_nothing_asked_and_nothing_known(spark, known, asked):
    none = retrieval.retrieve(asked.where("false"), known)
    assert none.outcomes.count() == none.evidence.count() == none.counts.count() == 0
    bare = retrieval.retrieve(asked.where("question_id = 3"), known)
    assert [r["outcome"] for r in bare.outcomes.collect()] == [router.NO_ENTITIES] and bare.evidence.count() == 0


def test_hubs_are_cut_before_questions_meet_them(spark):
    rules = spark.range(5000).selectExpr("concat('1.', id) as number", "'1' as parent", "2 as level", "'t' as text", "id as pos").unionByName(table(spark, [("1", None, 1, "t", -1)], "number string, parent string, level int, text string, pos long"))
    heads = retrieval.subtree_heads(rules, table(spark, [("1",)], "number string"), 25).collect()
    assert [(r["item_no"], r["number"]) for r in sorted(heads, key=lambda r: r["item_no"])] == [(i + 1, f"1.{i}") for i in range(25)]


def test_expanded_search(spark, known):
    q = table(spark, [(1, "What is that?"), (2, "Why?")], "question_id long, question string")
    more = table(spark, [(1, "loses all powers"), (1, "loses all powers")], "question_id long, text string")
    hits = S.search_evidence(known.rules.where("level > 1"), "number", "text", q, more, snippet=9).collect()
    assert hits[0]["key"] == "613.4" and hits[0]["text"] == "An object" and {r["question_id"] for r in hits} == {1}
    assert S.search_evidence(known.rules, "number", "text", q).count() == 0


def test_questions_are_made_once(spark, known):
    made = spark.sparkContext.accumulator(0)

    def said(q):
        made.add(1)
        return q

    asked = table(spark, ASKED, "question_id long, question string").withColumn("question", F.udf(said).asNondeterministic()("question"))
    got = retrieval.retrieve(asked, known)
    assert got.outcomes.count() == len(ASKED) and got.evidence.count() > 0
    assert made.value == len(ASKED)
