from __future__ import annotations

import gzip
import json

import pytest

from brindle.sources import records as R
from brindle.sources import rules_text as X
from brindle.streaming import ingest

CARDS = [
    {"oracle_id": "1", "name": "Wind // Rain", "layout": "split", "cmc": 2.0, "type_line": "Instant", "legalities": {"modern": "legal", "vintage": "banned"}, "card_faces": [{"name": "Wind"}, {"name": "Rain"}]},
    {"oracle_id": "2", "name": "Goblin", "layout": "token", "cmc": 0.0, "type_line": "Token Creature", "legalities": {"modern": "not_legal"}},
]

RULES = """﻿Rules of the Game

These rules are effective as of May 1.

Contents
1. Concepts
100. General
Glossary
Credits

1. Concepts

100. General

100.1. These rules apply. See rule 100.2.
Example: You play.
100.1a A two-line rule
  goes on here.

100.2. Another, see rules 100.1a and 999.9.

Glossary

Flying
See rule 100.2.

Empty

Credits

Thanks.
"""


def test_json_forms(spark, tmp_path):
    forms = {"a.json": "  \n" + json.dumps(CARDS), "b.jsonl": "\n".join(map(json.dumps, CARDS)) + "\n\n", "c.json": "\n".join(map(json.dumps, CARDS))}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write(forms["b.jsonl"])
    (tmp_path / "e.jsonl").write_text("")
    got = {n: sorted(r["name"] for r in R.read_json(spark, str(tmp_path / n), R.CARD).collect()) for n in (*forms, "d.jsonl.gz", "e.jsonl")}
    assert got.pop("e.jsonl") == []
    assert set(map(tuple, got.values())) == {("Goblin", "Wind // Rain")}
    assert R.resolve(spark, str(tmp_path), "d").endswith("d.jsonl.gz")


def test_cards(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CARDS))
    cards = R.read_cards(spark, str(tmp_path / "c.json"))
    assert [r["oracle_id"] for r in cards.collect()] == ["1"]
    assert [r["face_key"] for r in R.faces(cards).orderBy("index").collect()] == ["1#0", "1#1"]
    assert sorted((r["dst"], r["status"]) for r in R.legality_edges(cards).collect()) == [("modern", "legal"), ("vintage", "banned")]
    (tmp_path / "bad.json").write_text(json.dumps([CARDS[0] | {"cmc": None}]))
    with pytest.raises(Exception, match="no cmc"):
        R.read_cards(spark, str(tmp_path / "bad.json")).collect()


def test_golden(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('// comment\n\n{"id": "a", "hops": 1}\n{"id": "b", "hops": 2}\n')
    assert R.read_golden(spark, str(tmp_path / "g.jsonl")).count() == 2
    (tmp_path / "h.jsonl").write_text('{"id": "a"}\n')
    with pytest.raises(ValueError, match="more than one"):
        R.read_golden(spark, str(tmp_path / "g.jsonl"), str(tmp_path / "h.jsonl"))


def test_rules_text(spark, tmp_path):
    (tmp_path / "r.txt").write_text(RULES)
    lines = X.read_lines(spark, str(tmp_path / "r.txt"))
    rules = {r["number"]: r for r in X.parse_rules(lines).collect()}
    assert list(sorted(rules)) == ["100", "100.1", "100.1a", "100.2"]
    assert rules["100.1"]["examples"] == ["You play."] and rules["100.1"]["refs"] == ["100.2"] and rules["100.1"]["section"] == "Concepts"
    assert rules["100.1a"]["text"] == "A two-line rule goes on here." and rules["100.1a"]["parent"] == "100.1"
    assert rules["100.2"]["refs"] == ["100.1a"]
    glossary = X.parse_glossary(lines)
    assert [(r["term"], r["definition"]) for r in glossary.collect()] == [("Flying", "See rule 100.2.")]
    assert [(r["keyword"], r["number"]) for r in X.keyword_definitions(glossary, ("100",)).collect()] == [("flying", "100.2")]
    (tmp_path / "n.txt").write_text("nothing here")
    with pytest.raises(Exception, match="no rules"):
        X.parse_rules(X.read_lines(spark, str(tmp_path / "n.txt"))).collect()


def test_changed_sources(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    h = R.file_hashes(spark, str(tmp_path))
    known = h.where("name = 'a'")
    assert [r["name"] for r in R.changed_sources(h, known).collect()] == ["b"]
    assert R.changed_sources(h, known, force=True).count() == 2


def test_incremental_ingest(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"k": 1, "v": "a", "ord": 1}\n{"k": 2, "v": "b", "ord": 1}\n')
    args = (spark, str(src), "k int, v string, ord int", out, str(tmp_path / "cp"), "k", "ord")
    ingest.ingest_available(*args)
    (src / "2.json").write_text('{"k": 1, "v": "c", "ord": 2}\n')
    ingest.ingest_available(*args)
    last = spark.read.parquet(f"{out}/batch=1")
    assert sorted((r["k"], r["v"]) for r in last.collect()) == [(1, "c"), (2, "b")]
