"""Running values in ranges against windows, rules text in splits against the whole, and interval labels against a walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators.scan import running
from brindle.sources import rules_text as X


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_values_are_those_of_a_window(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)]), i, rng.choice([None, 1, 2, -5]), rng.choice([None, None, "x", "y", "z"])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int, s string").repartition(5)
    got = running(df, ["k"], ["o", "i"], sums={"total": F.col("v")}, lasts={"last": F.col("s")}, number="n", ranges=ranges)
    w = Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first(), "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"total": F.coalesce(F.sum("v").over(w), F.lit(0)), "last": F.last("s", ignorenulls=True).over(w), "n": F.row_number().over(w) - 1})
    key = lambda r: r["i"]
    assert [tuple(r) for r in sorted(got.select(want.columns).collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    assert got.columns == ["k", "o", "i", "v", "s", "total", "n", "last"]


def test_one_group_is_spread_over_ranges(spark):
    df = spark.range(4000).selectExpr("1 as k", "id as o")
    n = running(df, ["k"], ["o"], number="n", ranges=8).withColumn("p", F.spark_partition_id())
    assert n.where("n <> o").count() == 0
    equal = spark.range(3000).selectExpr("1 as k", "2 as o")
    assert [tuple(r) for r in running(equal, ["k"], ["o"], number="n", ranges=8).agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()] == [(0, 2999, 3000)]
    assert running(df.where("false"), ["k"], ["o"], number="n").count() == 0


def text(n):
    body = "".join(f"100.{i}. Rule {i}, see rule 100.{i + 1}.\r\nExample: It follows from rule 100.{i}a.\r\n  and on\r\n\r\n100.{i}a Sub {i}\r\n" for i in range(1, n))
    return "﻿These rules are effective as of May 1, 2024. More.\r\n1. Start\r\n100. General\r\nGlossary\r\nCredits\r\n\r\n1. Start\r\n100. General\r\n" + body + "Glossary\r\n\r\n" + "".join(f"Term {i}\r\nSee rule 100.{i} and rule 7.\r\nagain\r\n\r\n" for i in range(1, n)) + "Lone\r\n\r\nCredits\r\n"


def test_rules_text_in_splits(spark, tmp_path):
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "r.txt").write_bytes(text(120).encode())
    (tmp_path / "whole" / "s.txt").write_bytes(text(4).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    for size in (before, "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = X.read_lines(spark, str(tmp_path / "whole"), ranges=6)
            assert (size == before) or spark.read.text(str(tmp_path / "whole")).rdd.getNumPartitions() > 10
            rules, glossary = X.parse_rules(lines, ranges=6), X.parse_glossary(lines, ranges=6)
            name = F.element_at(F.split("doc", "/"), -1)
            got.append([sorted(map(str, df.withColumn("doc", name).collect())) for df in (lines, rules, glossary, X.glossary_references(glossary, rules), X.effective_dates(lines))])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1]
    rules = {(r["doc"][-5:], r["number"]): r for r in X.parse_rules(X.read_lines(spark, str(tmp_path / "whole"))).collect()}
    assert len([k for k in rules if k[0] == "r.txt"]) == 1 + 2 * 119
    assert rules["r.txt", "100.5"]["refs"] == ["100.6", "100.5a"] and rules["r.txt", "100.5"]["text"] == "Rule 5, see rule 100.6. and on" and rules["r.txt", "100.119"]["refs"] == ["100.119a"]
    assert rules["s.txt", "100.3a"]["text"] == "Sub 3" and rules["s.txt", "100.3a"]["parent"] == "100.3"
    dates = {r["effective_date"] for r in X.effective_dates(X.read_lines(spark, str(tmp_path / "whole"))).collect()}
    assert dates == {"May 1, 2024"}
    entries = X.parse_glossary(X.read_lines(spark, str(tmp_path / "whole" / "s.txt"))).collect()
    assert sorted((r["term"], r["definition"]) for r in entries) == [(f"Term {i}", f"See rule 100.{i} and rule 7. again") for i in (1, 2, 3)]


def walk(rows):
    kids: dict = {}
    names = {n for n, _, _ in rows}
    for n, p, pos in rows:
        kids.setdefault(p if p in names else None, []).append((pos, n))
    out, at = {}, 0

    def go(n, depth):
        nonlocal at
        enter, at = at, at + 1
        for _, c in sorted(kids.get(n, [])):
            go(c, depth + 1)
        out[n] = (enter, at - 1, depth)

    for _, n in sorted(kids.get(None, [])):
        go(n, 1)
    return out


def test_interval_labels(spark):
    rng = random.Random(5)
    rows = [("613", None, 0), ("613.4", "613", 1), ("613.41", "613", 2), ("613.4a", "613.4", 9), ("613.4b", "613.4", 9), ("x", "absent", 5)]
    rows += [(f"n{i}", f"n{rng.randrange(i)}" if i else "613.4b", rng.randrange(5)) for i in range(150)]
    rows += [(f"d{i}", f"d{i - 1}" if i else None, 7) for i in range(40)]
    tree = spark.createDataFrame(rows, "number string, parent string, pos long").repartition(3)
    labels = G.interval_labels(tree)
    want = walk(rows)
    assert {r["number"]: (r["enter"], r["leave"], r["depth"]) for r in labels.collect()} == want
    for width in (4096, 8):
        got = G.subtrees_by_label(labels, spark.createDataFrame([("613.4",), ("613.41",), ("d3",), ("nowhere",)], "number string"), width).collect()
        for root in ("613.4", "613.41", "d3"):
            lo, hi, depth = want[root]
            below = sorted((r["place"], r["number"], r["distance"]) for r in got if r["root"] == root)
            assert below == sorted((e - lo, n, d - depth) for n, (e, _, d) in want.items() if lo <= e <= hi)
        assert not any(r["root"] == "nowhere" for r in got)
    assert max(d for _, _, d in want.values()) > 3


def test_cycles_and_repeated_numbers_fail(spark):
    with pytest.raises(ValueError, match="repeated"):
        G.interval_labels(spark.createDataFrame([("a", None, 1), ("a", None, 2)], "number string, parent string, pos long"))
    with pytest.raises(ValueError, match="cycle"):
        G.interval_labels(spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", None, 3)], "number string, parent string, pos long"))
    assert G.interval_labels(spark.createDataFrame([], "number string, parent string, pos long")).count() == 0
