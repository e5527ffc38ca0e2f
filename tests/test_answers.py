"""Answers with citations in place, prompts, candidate rules, audits and the life of labels."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import answers as A
from brindle.operators import audits as U
from brindle.operators import evaluation as V
from brindle.operators import graph as G

RULES = [("702", None, 1, "Keywords", 0), ("702.9", "702", 2, "Flying", 1), ("702.9a", "702.9", 3, "A flyer is hard to block", 2), ("702.9b", "702.9", 3, "It flies", 3), ("702.90", "702", 2, "Soaring", 4), ("613", None, 1, "Layers", 5), ("613.4", "613", 2, "x" * 300, 6)]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "number string, parent string, level int, text string, pos long")


def test_answers_are_put_together_again(spark):
    said = [
        (1, "See [rule:1; ruling:1] and [rule:1]. Then [card:z;rule:9].[rule:1]"), (2, "Nothing cited."), (3, None), (4, ""), (5, "[rule:1]"), (6, "a [; ] b [x: ] [rule 1]"), (7, "[odd:k] é😀 [odd:k]"),
    ]
    have = [(1, "rule:1", "rule", "1.1", "p"), (1, "rule:1", "rule", "1.1", "p"), (1, "ruling:1", "ruling", "abc", None), (7, "odd:k", "oddity", "K", "")]
    evidence = spark.createDataFrame(have, "question_id long, handle string, kind string, key string, path string")
    got = {r["question_id"]: (r["text"], r["unknown"]) for r in A.written_out(spark.createDataFrame(said, "question_id long, answer string"), evidence).collect()}
    assert got[1] == ("See [path: p] [CR 1.1] [ruling abc] and [path: p] [CR 1.1]. Then [UNVERIFIED card:z] [UNVERIFIED rule:9].[path: p] [CR 1.1]", ["card:z", "rule:9"])
    assert got[2] == ("Nothing cited.", []) and got[3] == (None, []) and got[4] == ("", [])
    assert got[5] == ("[UNVERIFIED rule:1]", ["rule:1"])  # another question's evidence is none
    assert got[6][0].startswith("a [; ] b ") and got[7] == ("[oddity K] é😀 [oddity K]", [])
    assert A.written_out(spark.createDataFrame([], "question_id long, answer string"), evidence).count() == 0


def test_prompts(spark, rules):
    block = A.grounding(rules).first()["block"]
    assert block.index("613 Layers") < block.index("702 Keywords") < block.index("702.9 Flying") and "702.90 Soaring" in block and "613.4" not in block
    assert "702.9 Flying" not in A.grounding(rules, with_keywords=False).first()["block"]
    labels = G.interval_labels(rules)
    keyed = spark.createDataFrame([("a", "soaring", 0), ("a", "flying", 1), ("a", "flying", 2), ("b", "layers", 0), ("c", "none", 0)], "owner string, keyword string, nth int")
    defined = spark.createDataFrame([("flying", "702.9"), ("soaring", "702.90"), ("layers", "613"), ("soaring", "702.9")], "keyword string, number string")
    got = A.candidate_rules(keyed, defined, labels, rules, most=1).orderBy("owner", "place").collect()
    assert [(r["owner"], r["place"], r["number"]) for r in got] == [("a", 1, "702.9"), ("a", 2, "702.9a"), ("a", 3, "702.90"), ("b", 1, "613"), ("b", 2, "613.4")]
    assert len(got[-1]["snippet"]) == A.SNIPPET
    rulings = spark.createDataFrame([("a", "It flies."), ("z", None)], "ruling_id string, text string")
    prompts = {r["ruling_id"]: r["prompt"] for r in A.ruling_prompts(rulings, A.candidate_rules(keyed, defined, labels, rules).withColumnRenamed("owner", "ruling_id"), "Lead.").collect()}
    assert prompts["a"].startswith("Lead.\n\nRules that") and "\n- 702.9: Flying\n- 702.9a:" in prompts["a"] and prompts["a"].endswith('Ruling: "It flies."') and prompts["z"] == 'Lead.\n\nRuling: ""'
    pending = spark.createDataFrame([("a", 7, "Clone", ["123456789", "2"]), ("a", 1, "Clone", ["3"])], "ruling_id string, start int, surface string, candidates array<string>")
    assert A.mention_prompts(pending, rulings).first()["prompt"].endswith('1. "Clone" at 1, may be 3\n2. "Clone" at 7, may be 12345678, 2')


def test_findings(spark, rules):
    rulings = spark.createDataFrame([(1, "hard flyers fly"), (2, "nothing shared"), (3, ""), (4, None)], "ruling_id int, text string")
    cites = spark.createDataFrame([(1, "702.9a"), (1, "702.9a"), (2, "702.9a"), (2, "702"), (2, "999.1"), (3, "702.9a"), (4, "613.4"), (4, None)], "ruling_id int, number string")
    got = sorted((r["ruling_id"], r["number"] or "", r["check"], r["severity"], r["n"]) for r in U.findings(cites, rulings, rules).collect())
    assert got == [(1, "702.9a", "duplicate", "error", 2), (2, "702", "chapter-level", "error", 1), (2, "702.9a", "no-shared-vocabulary", "review", 1), (2, "999.1", "unresolvable", "error", 1), (4, "", "unresolvable", "error", 1)]


def test_canonical_citations(spark):
    kind = "id int, c array<struct<rule_number:string,rule:string,start:int,end:int,quote:string,text:string>>"
    rows = spark.createDataFrame([
        (1, [("1.1", None, 0, 3, "abc", None), ("1.2", None, 0, 3, "", None), (None, "1.3", None, None, None, "said"), ("", "1.4", 1, None, "q", None)]), (2, None), (3, []), (4, [("2.1", None, None, None, None, None)]),
    ], kind)
    got = {r["id"]: [tuple(x) for x in r["n"]] for r in rows.select("id", U.canonical_citations(F.col("c")).alias("n")).collect()}
    assert got == {1: [("1.1", 0, 3, "abc"), ("1.2", None, None, None), ("1.3", None, None, None), ("1.4", None, None, None)], 2: [], 3: [], 4: [("2.1", None, None, None)]}
    assert tuple(U.citation_changes(rows, "c").first()) == (5, 3, 1)
    assert tuple(U.citation_changes(rows.where("id = 3"), "c").first()) == (0, 0, 0)


def test_authored_rows(spark, rules):
    cards = spark.createDataFrame([("Grey Heron",)], "name string")
    schema = "id string, question string, gold_entities array<string>, gold_cr_rules array<string>"
    good = spark.createDataFrame([("q1", "Can it fly?", ["Grey Heron"], ["702.9"]), ("q2", "?", [], None)], schema)
    assert [r["verified"] for r in U.authored(good, cards, rules).collect()] == [False, False]
    for row, reason in ((("q3", "?", ["Nobody"], []), "gold_entities: unknown .'Nobody'"), (("q3", "?", [], ["999.9"]), "gold_cr_rules"), (("q1", "?", [], []), "twice")):
        with pytest.raises(ValueError, match=reason):
            U.authored(good.unionByName(spark.createDataFrame([row], schema)), cards, rules)


def test_the_life_of_sufficiency_labels(spark):
    outcomes = spark.createDataFrame([(1, "resolved"), (2, "no_match"), (3, "resolved")], "question_id int, outcome string")
    counts = spark.createDataFrame([(1, 2), (1, 3), (3, 1)], "question_id int, kept long")
    first = U.sufficiency_init(outcomes, counts)
    assert sorted((r["question_id"], r["evidence"], r["label"]) for r in first.collect()) == [(1, 5, None), (2, 0, None), (3, 1, None)]
    labelled = first.withColumn("label", F.when(F.col("question_id") == 2, "insufficient").otherwise("sufficient"))
    again = U.sufficiency_reopen(labelled, spark.createDataFrame([(1,)], "question_id int"), spark.createDataFrame([(3,)], "question_id int"))
    assert sorted((r["question_id"], r["label"], r["stale_label"]) for r in again.collect()) == [(1, None, None), (2, "insufficient", "insufficient"), (3, "sufficient", "sufficient")]
    with pytest.raises(ValueError, match="read already"):
        U.sufficiency_reopen(labelled, spark.createDataFrame([(1,)], "question_id int"), spark.createDataFrame([(1,)], "question_id int"))
    assert U.label_hash(labelled).first() == U.label_hash(labelled.orderBy(F.desc("question_id"))).first() != U.label_hash(again).first()


def test_dumped_records(spark, tmp_path):
    questions = spark.createDataFrame([(1, "a?"), (2, "b?")], "question_id int, question string")
    outcomes = spark.createDataFrame([(1, "resolved"), (2, "no_match")], "question_id int, outcome string")
    rows = [(1, 2, "rule", "1.1", "t", "x", "p", 1, 4), (1, 1, "card", "c", "u", "x", "p", 0, 3)]
    evidence = spark.createDataFrame(rows, "question_id int, arrival long, kind string, key string, text string, template string, path string, distance int, tokens long")
    records = A.retrieval_records(questions, outcomes, evidence)
    A.dump(records, str(tmp_path / "d"))
    said = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "d")).collect()), key=lambda r: r["question_id"])
    assert [e["key"] for e in said[0]["evidence"]] == ["c", "1.1"] and said[0]["tokens"] == 7 and said[1]["evidence"] == [] and said[1]["tokens"] == 0
    with pytest.raises(Exception, match="(?i)exists"):
        A.dump(records, str(tmp_path / "d"))


def test_aggregates_of_evaluations(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "doc int, item string")
    found = spark.createDataFrame([(1, "a"), (1, "z"), (9, "c")], "doc int, item string")
    assert sorted(tuple(r) for r in V.retrieval_recall(gold, found, "doc", "item").collect()) == [(1, 0.5), (2, 0.0)]
    s = spark.createDataFrame([(1, True, True), (1, False, True), (2, True, False), (3, None, None)], "a int, c boolean, f boolean")
    assert tuple(V.coverage(s, "a", "c", "f").first()) == (1, 2, 2, 4, 1, 3, 0.5, True)
    empty = V.coverage(s.where("false"), "a", "c", "f").first()
    assert empty["rate"] is None and empty["segmented"] == 0
    assert [tuple(r) for r in V.histogram(spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "code string"), "code").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert sorted(tuple(r) for r in V.counts_of(spark.createDataFrame([("x",), ("q",)], "s string"), "s", ("x", "y")).collect()) == [("x", 1), ("y", 0)]
    rates = V.hit_rates(spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "k int, g string"), spark.createDataFrame([(1, 1, 1), (1, 0, 1), (3, 0, 1)], "k int, hit int, near int"), "k", "g", "hit", "near")
    assert sorted(tuple(r) for r in rates.collect()) == [("all", 3, 1, 0.333333, 2, 0.666667), ("s", 2, 1, 0.5, 1, 0.5), ("t", 1, 0, 0.0, 1, 1.0)]
