"""Loading into a store: skips, counts, parts, failures between tables, two loads at once, and row builders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import gate, loader
from brindle.sources import records, rows, rules_text
from brindle.sources.snapshots import Store

CARDS = [
    {"oracle_id": "a", "name": "Grey  Hérón", "layout": "normal", "cmc": 1.0, "type_line": "Bird", "keywords": ["Flying", "flying", "Reach"], "legalities": {"modern": "legal"}, "card_faces": None},
    {"oracle_id": "b", "name": "Fire // Ice", "layout": "split", "cmc": 2.0, "type_line": "Spell", "keywords": [], "legalities": {"modern": "banned"}, "card_faces": [{"name": "Fire"}, {"name": "Ice"}]},
]
RULES = """1. Game
1. Game
100. General
100.1. These rules apply. See rule 702.9a.
7. More
702. Keywords
702.9. Flying
702.9a Flying is good.
Glossary
Flying
A keyword. See rule 702.9, "Flying."

Credits
nobody
"""
RULINGS = [{"oracle_id": "a", "published_at": "2020-01-01", "source": "x", "comment": "It flies."}, {"oracle_id": "zz", "published_at": None, "source": "x", "comment": "lost"}, {"oracle_id": None, "comment": "lost"}]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def table(spark, *ids):
    return spark.createDataFrame([(i, i % 2) for i in ids], "id long, v long")


def source(spark, name, sha, ids, table_name=None):
    return loader.Source(name, sha, lambda _: {table_name or name: table(spark, *ids)}, {table_name or name: ("id",)})


def said(report):
    return sorted((r["source"], r["table_name"], r["part"], r["outcome"], r["n_rows"], r["created"], r["deleted"]) for r in report.collect())


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_sources_are_skipped_by_hash(spark, store):
    m, report = loader.load_all(store, [source(spark, "x", "1", [1, 2]), source(spark, "y", "1", [5])])
    assert m.version == 1 and said(report) == [("x", "x", "", "loaded", 2, 2, 0), ("y", "y", "", "loaded", 1, 1, 0)]
    m, report = loader.load_all(store, [source(spark, "x", "1", [1, 2]), source(spark, "y", "2", [6, 7])])
    assert m.version == 2 and said(report) == [("x", "", "", "skipped", 0, 0, 0), ("y", "y", "", "loaded", 2, 2, 1)]
    assert ids(store.read("x")) == [1, 2] and ids(store.read("y")) == [6, 7] and ids(store.read("y", manifest=store.manifest(1))) == [5]
    m, report = loader.load_all(store, [source(spark, "x", "1", [1, 2])], force=True)
    assert m.version == 3 and said(report) == [("x", "x", "", "loaded", 2, 0, 0)]
    m, report = loader.load_all(store, [source(spark, "x", "1", []), source(spark, "y", "2", [])])
    assert m.version == 3 and {r[3] for r in said(report)} == {"skipped"}


def test_a_failure_between_two_tables_changes_nothing(spark, store):
    loader.load_all(store, [source(spark, "x", "1", [1]), source(spark, "y", "1", [1])])

    def dies(read):
        assert ids(read("x")) == [2]  # what is staged is seen by what comes after it
        return {"y": table(spark, 9).withColumn("v", F.raise_error(F.lit("no")).cast("long"))}

    with pytest.raises(Exception, match="no"):
        loader.load_all(store, [source(spark, "x", "2", [2]), loader.Source("y", "2", dies)])
    assert store.manifest().version == 1 and ids(store.read("x")) == ids(store.read("y")) == [1] and store.manifest().sources == {"x": "1", "y": "1"}
    with pytest.raises(ValueError, match="repeated"):
        loader.load_all(store, [source(spark, "x", "3", [3, 3])])
    assert ids(store.read("x")) == [1]
    loader.load_all(store, [source(spark, "x", "2", [2])])
    assert len(store.vacuum(keep=1)) == 4 and ids(store.read("x")) == [2] and ids(store.read("y")) == [1]  # first x, staged and failed x, failed y, repeated x


def test_two_loads_from_one_manifest(spark, store):
    base = store.manifest()
    entry = store.stage("x", table(spark, 1))
    store.commit(base, {"x": "1"}, {"x": entry})
    with pytest.raises(RuntimeError, match="another load"):
        store.commit(base, {"x": "2"}, {"x": store.stage("x", table(spark, 2))})
    assert ids(store.read("x")) == [1] and store.manifest().version == 1


def test_partial_loads_are_brought_again(spark, store):
    part = loader.Source("x", "1", lambda _: {"x": table(spark, 1)}, partial=True)
    loader.load_all(store, [part])
    assert ids(store.read("x")) == [1] and store.manifest().sources == {}
    _, report = loader.load_all(store, [source(spark, "x", "1", [1, 2])])
    assert said(report) == [("x", "x", "", "loaded", 2, 1, 0)]


def test_parts_of_a_table(spark, store):
    edges = lambda *rows: spark.createDataFrame(rows, "src string, dst string, edge_type string")
    one = lambda name, sha, owned, *rows: loader.Source(name, sha, lambda _: {"edge": edges(*rows)}, {"edge": ("src", "dst")}, {"edge": "edge_type"}, {"edge": owned})
    _, report = loader.load_all(store, [one("p", "1", ("A", "B"), ("1", "2", "A"), ("1", "3", "B")), one("q", "1", ("C/d e",), ("4", "5", "C/d e"))])
    assert said(report) == [("p", "edge", "A", "loaded", 1, 1, 0), ("p", "edge", "B", "loaded", 1, 1, 0), ("q", "edge", "C/d e", "loaded", 1, 1, 0)]
    before = store.manifest().tables["edge"]["parts"]
    _, report = loader.load_all(store, [one("p", "2", ("A", "B"), ("1", "2", "A"), ("1", "9", "A")), one("q", "1", ("C/d e",))])
    assert said(report) == [("p", "edge", "A", "loaded", 2, 1, 0), ("p", "edge", "B", "loaded", 0, 0, 1), ("q", "", "", "skipped", 0, 0, 0)]
    after = store.manifest().tables["edge"]["parts"]
    assert set(after) == {"A", "C/d e"} and after["C/d e"] == before["C/d e"] and after["A"] != before["A"]
    assert sorted(tuple(r) for r in store.read("edge").collect()) == [("1", "2", "A"), ("1", "9", "A"), ("4", "5", "C/d e")]
    assert [tuple(r) for r in store.read("edge", "C/d e").collect()] == [("4", "5", "C/d e")] and store.read("edge", "none").count() == 0
    with pytest.raises(ValueError, match="again"):
        loader.load_all(store, [one("p", "3", (), ("1", "2", "A")), one("q", "3", (), ("1", "2", "A"))])


def test_gated_edges_by_type(spark, store):
    cols = "ord long, edge_type string, source_key string, target_key string, span_start int, span_end int, span_text string, method string, confidence double"
    cand = spark.createDataFrame([(1, "MENTIONS", "r", "c", 0, 2, "ab", "exact", 1.0), (2, "CITES_RULE", "r", "1.1", 0, 2, "ab", "llm", 0.9), (3, "MENTIONS", "r", "no", 0, 2, "ab", "exact", 1.0)], cols)
    judged = gate.gate(cand, spark.createDataFrame([("r", "abc")], "source_key string, text string"), spark.createDataFrame([("1.1",)], "number string"), spark.createDataFrame([("c",)], "card_id string"))
    m, report = loader.load_edges(store, judged, "v1")
    assert said(report) == [("gate", "gated_edge", "CITES_RULE", "loaded", 1, 1, 0), ("gate", "gated_edge", "MENTIONS", "loaded", 1, 1, 0)] and set(m.tables["gated_edge"]["parts"]) == {"CITES_RULE", "MENTIONS"}
    with pytest.raises(TypeError):
        loader.load_edges(store, cand, "v1")


def test_the_three_sources_end_to_end(spark, store, tmp_path):
    (tmp_path / "cards.json").write_text(json.dumps(CARDS))
    (tmp_path / "rulings.jsonl").write_text("\n".join(map(json.dumps, RULINGS)))
    (tmp_path / "rules.txt").write_text(RULES)

    def of_rules(_):
        lines = rules_text.read_lines(spark, str(tmp_path / "rules.txt"))
        return rows.rule_tables(rules_text.parse_rules(lines), rules_text.parse_glossary(lines))

    hashed = lambda name: loader.listing_hash(spark, str(tmp_path / name))
    all_sources = lambda: [
        loader.Source("cards", hashed("cards.json"), lambda _: rows.card_tables(records.read_cards(spark, str(tmp_path / "cards.json"))), {"card": ("oracle_id",), "face": ("face_key",), "edge": ("src", "dst")}, {"edge": "edge_type"}),
        loader.Source("rules", hashed("rules.txt"), of_rules, {"rule": ("number",), "edge": ("src", "dst")}, {"edge": "edge_type"}),
        loader.Source("rulings", hashed("rulings.jsonl"), lambda read: rows.ruling_tables(records.read_json(spark, str(tmp_path / "rulings.jsonl"), records.RULING), read("card")), {"ruling": ("ruling_id",), "edge": ("src", "dst")}, {"edge": "edge_type"}),
    ]
    _, report = loader.load_all(store, all_sources())
    n = {(r[1], r[2]): r[4] for r in said(report)}
    assert n == {("card", ""): 2, ("face", ""): 2, ("edge", "HAS_LEGALITY"): 2, ("edge", "HAS_KEYWORD"): 2, ("rule", ""): 5, ("edge", "HAS_SUBRULE"): 3, ("edge", "REFERENCES"): 1, ("edge", "DEFINED_BY"): 1, ("ruling", ""): 1, ("edge", "HAS_RULING"): 1}
    cards = {r["oracle_id"]: r["normalized_name"] for r in store.read("card").collect()}
    assert cards["a"] == "grey heron"
    edges = sorted((r["src"], r["dst"], r["display_name"]) for r in store.read("edge", "HAS_KEYWORD").collect())
    assert edges == [("a", "flying", "Flying"), ("a", "reach", "Reach")]
    assert [(r["src"], r["dst"]) for r in store.read("edge", "DEFINED_BY").collect()] == [("flying", "702.9")]
    _, report = loader.load_all(store, all_sources())
    assert {r[3] for r in said(report)} == {"skipped"}
    (tmp_path / "rulings.jsonl").write_text("\n".join(map(json.dumps, RULINGS[:1] * 2 + [dict(RULINGS[0], comment="Twice.")])))
    _, report = loader.load_all(store, all_sources())
    assert [r for r in said(report) if r[3] == "loaded"] == [("rulings", "edge", "HAS_RULING", "loaded", 2, 1, 0), ("rulings", "ruling", "", "loaded", 2, 1, 0)]
