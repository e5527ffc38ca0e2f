"""Routing: linked entities to template calls, with every question of a batch planned in one pass."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_block, locate_quote

RESOLVED, AMBIGUOUS, NO_ENTITIES, NO_MATCH, NO_SEED = "resolved", "ambiguous", "no_entities", "no_match", "no_seed"
#: What each kind of entity asks for, in order.
CALLS = {
    "rule": ("rule_subtree", "rule_neighbourhood"),
    "keyword": ("keyword_definition",),
    "card": ("card_core", "card_keyword_rules", "card_rulings"),
    "format": (),
}


def outcomes(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, outcome) before any traversal: a question with one sure entity is resolved; ambiguous names stop one that has no other."""
    per = entities.groupBy("question_id").agg(F.count_if("ambiguous").alias("amb"), F.count_if(~F.col("ambiguous")).alias("sure"))
    out = questions.select("question_id").join(per, "question_id", "left")
    return out.select("question_id", F.when(F.col("sure") > 0, RESOLVED).when(F.col("amb") > 0, AMBIGUOUS).otherwise(NO_ENTITIES).alias("outcome"))


def search_calls(questions: DataFrame, entities: DataFrame, seeded: DataFrame) -> DataFrame:
    """(question_id, call_no, template, key, other): text searches of the resolved questions that reach no rule by the graph and name no format.

    ``seeded`` is (question_id, seeded).
    """
    ok = outcomes(questions, entities).where(F.col("outcome") == RESOLVED).select("question_id")
    named = entities.where("kind = 'format' and not ambiguous").select("question_id")
    bare = ok.join(seeded.where("seeded"), "question_id", "left_anti").join(named, "question_id", "left_anti")
    none = F.lit(None).cast("string")
    return bare.select("question_id", F.lit(1 << 20).alias("call_no"), F.lit("text_search").alias("template"), none.alias("key"), none.alias("other"))


def plan_calls(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, call_no, template, key, other): template calls of the resolved questions.

    ``entities`` is (question_id, pos, kind, key, ambiguous); only sure ones are asked for, one named again once.  A card asks for its legality in
    each format named; the first two cards of a question also for their interaction.
    """
    e = entities.where("not ambiguous").join(questions.select("question_id"), "question_id", "left_semi")
    e = e.groupBy("question_id", "kind", "key").agg(F.min("pos").alias("pos"))
    names = F.create_map(*[x for k, v in CALLS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    plain = e.select("question_id", "pos", "kind", "key", F.posexplode(F.element_at(names, F.col("kind"))).alias("i", "template"), F.lit(None).cast("string").alias("other"))
    cards, formats = e.where("kind = 'card'"), e.where("kind = 'format'").select("question_id", F.col("key").alias("other"))
    legal = cards.join(formats, "question_id").select("question_id", "pos", "kind", "key", F.lit(8).alias("i"), F.lit("card_legality").alias("template"), "other")
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("pos"))
    two = cards.withColumn("n", n).where("n <= 2").groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("c")).where("size(c) = 2")
    inter = two.select("question_id", F.lit(1 << 20).alias("pos"), F.lit("card").alias("kind"), F.col("c")[0]["key"].alias("key"), F.lit(9).alias("i"), F.lit("card_interaction").alias("template"), F.col("c")[1]["key"].alias("other"))
    rank = F.coalesce(F.array_position(F.array(F.lit("rule"), F.lit("keyword"), F.lit("card")), F.col("kind")), F.lit(9))
    calls = plain.unionByName(legal).unionByName(inter).withColumn("_k", rank)
    w = Window.partitionBy("question_id").orderBy("_k", "pos", "i", "other")
    return calls.withColumn("call_no", F.row_number().over(w)).select("question_id", "call_no", "template", "key", "other")


REFUSAL_MARK = "CANNOT ANSWER"


def answer(outcome: str, body: str, question: str, generate: Callable[[str, str], str], known: frozenset[str] | None = None) -> dict:
    """One question's answer from its evidence text by an injected generator; refused without one where nothing was found.

    With ``known`` handles the ones that the answer cites and nobody gave it are named, first seen first.
    """
    if outcome != RESOLVED or not body:
        return {"refused": True, "text": "", "reason": outcome, "unknown": []}
    said = generate(question, body)
    cited = [h.strip() for m in re.findall(r"\[([a-z]+:[^\]]+)\]", said) for h in m.split(";")]
    unknown = [] if known is None else [h for h in dict.fromkeys(cited) if h and h not in known]
    return {"refused": REFUSAL_MARK in said, "text": said, "reason": "generator" if REFUSAL_MARK in said else "", "unknown": unknown}


def parsed_replies(replies: DataFrame) -> DataFrame:
    """(ruling_id, quote, number, start, end, reason) from model replies (ruling_id, text, reply): an array of {quote, rule} objects.

    A reply without such an array, a quote that doesn't stand in the text and a missing number are dropped with their reason; counts come by a grouping.
    """
    item = F.from_json(json_block(F.col("reply")), "array<struct<quote:string,rule:string>>")
    rows = replies.select("ruling_id", "text", F.explode_outer(F.when(F.size(item) > 0, item)).alias("i"))
    at = locate_quote(F.col("text"), F.col("i.quote"))
    reason = F.when(F.col("i").isNull(), "unparsed").when(F.coalesce(F.trim("i.quote"), F.lit("")) == "", "no_quote").when(at.isNull(), "quote_not_in_text").when(F.coalesce("i.rule", F.lit("")) == "", "no_rule")
    return rows.select("ruling_id", F.col("i.quote").alias("quote"), F.col("i.rule").alias("number"), at["start"].alias("start"), at["end"].alias("end"), reason.alias("reason"))
