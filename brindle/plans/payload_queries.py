"""Payload queries: events as an API's questions, whose lists mix texts, objects and numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import payloads as P
from .binding import Tables
from .catalogue import register


#: Events that one task makes payloads of and reads, about: a row's work is far more than its bytes, by which files are split.
PER_TASK = 20_000


def event_payloads(t: Tables) -> DataFrame:
    """(payload): an event's kind and props as JSON; cited rules are a text, objects under three names, a number, an empty object and a null."""
    k = F.get_json_object("props", "$.k")
    said = (
        '{"url": "http://q/%s", "id": %s, "question": "%s?", "includedCards": [{"name": "%s", "props": %s}, {"nick": "x"}, "loose", {"name": ""}, {"name": "User %s"}], '
        '"citedRules": ["1%s.1", {"ruleNumber": "2%s.2", "number": "no"}, {"ruleNumber": "", "number": 3%s}, 7, {}, null, {"id": "%sb"}, {"number": ["no"]}], "answer": null}'
    )
    id_ = F.col("event_id").cast("string")
    events = t.t("events").select("event_id", "event_type", "props", "user_id")
    events = events.repartition(math.ceil(events.count() / PER_TASK) or 1, "event_id")
    return events.select(F.format_string(said, id_, id_, "event_type", "event_type", "props", "user_id", k, k, k, k).alias("payload"))


@register(
    "payload_skeletons",
    "SELECT 'rg-' || event_id AS id, event_type || ';User ' || user_id AS gold_entities, '1' || k || '.1;2' || k || '.2;3' || k || ';' || k || 'b' AS gold_cr_rules, 'http://q/' || event_id AS url, false AS verified, "
    """sha256('"' || event_type || '?"' || chr(10) || 'null' || chr(10) || '[{"name":"' || event_type || '","props":{"k":' || k || '}},{"nick":"x"},"loose",{"name":""},{"name":"User ' || user_id || '"}]' || chr(10) || """
    """'["1' || k || '.1",{"number":"no","ruleNumber":"2' || k || '.2"},{"number":3' || k || ',"ruleNumber":""},7,{},null,{"id":"' || k || 'b"},{"number":["no"]}]') AS snapshot_sha256 """
    "FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)",
)
def payload_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.skeletons(event_payloads(Tables(spark, sf_dir)), "payload")
    return rows.select("id", F.array_join("gold_entities", ";").alias("gold_entities"), F.array_join("gold_cr_rules", ";").alias("gold_cr_rules"), "url", "verified", "snapshot_sha256")
