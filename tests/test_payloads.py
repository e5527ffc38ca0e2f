"""Payloads of no fixed schema as skeleton rows."""

from __future__ import annotations

from brindle.plans import payload_queries
from brindle.plans.binding import Tables
from brindle.sources import payloads as P


def test_skeletons(spark):
    said = [
        '{"id": 7, "includedCards": [{"name": "A"}, {"name": null}, {}, 3, "x"], "citedRules": ["1.1", {"ruleNumber": "2.2"}, {"number": 3}, {"id": "4"}, {"ruleNumber": "", "id": "5"}, 6, null, [], true], "url": "u"}',
        '{"citedRules": ["1.1"],\n "id": "8", "includedCards": {"name": "not a list"}}',
        '{"id": "8b", "includedCards": {"name": "not a list"}, "citedRules": ["1.1"]}',
        '{"id": null}', '{"id": ""}', "{}", "[1]", "3", "no json", "", None, '{"id": {"a": 1}}',
    ]
    got = {r["id"]: r for r in P.skeletons(spark.createDataFrame([(s, "clash") for s in said], "payload string, id string"), "payload").collect()}
    assert set(got) == {"rg-7", "rg-8", "rg-8b"}
    assert got["rg-7"]["gold_entities"] == ["A"] and got["rg-7"]["gold_cr_rules"] == ["1.1", "2.2", "3", "4", "5"] and got["rg-7"]["url"] == "u" and got["rg-7"]["verified"] is False
    assert got["rg-8"]["gold_entities"] == [] and got["rg-8"]["url"] is None
    assert got["rg-8"]["snapshot_sha256"] == got["rg-8b"]["snapshot_sha256"] != got["rg-7"]["snapshot_sha256"]
    assert P.skeletons(spark.createDataFrame([], "payload string"), "payload").count() == 0


def test_payloads_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    spark.range(1000).selectExpr("id as event_id", "'view' as event_type", "'{\"k\": 1}' as props", "id % 7 as user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(payload_queries, "PER_TASK", 100, raising=False)
    rows = payload_queries.event_payloads(Tables(spark, str(tmp_path)))
    assert rows.count() == 1000 and rows.rdd.getNumPartitions() == 10


def test_payloads_are_parsed_once(spark):
    rows = P.skeletons(spark.range(3).selectExpr("concat('{\"id\": ', id, '}') as payload").repartition(2), "payload")
    assert rows.count() == 3
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
