"""Retrieval end to end for a batch of questions: linking, planning, one run of each template for all its calls, text search, bounds, and a last resort.

Everything is a join of calls (question_id, call_no, key, other) with the graph's tables.  What hangs on a hub is cut to the rows that a cap can let in once for each hub, before questions meet it,
so evidence grows with the questions and not with the hubs they ask about.  Outcomes name why a question has no evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evidence as E
from . import linking as L
from . import router as R
from . import search as S
from .cuts import at_hand, cut
from .graph import MAX_TREE_DEPTH, descendants

ROW_LIMIT = 50
TEXT_SEARCH = "text_search"
LAST_RESORT = "last_resort"


@dataclass(frozen=True)
class Knowledge:
    """The graph's tables as retrieval reads them; keys of cards are strings.

    cards (card_id, name, text), card_keywords (card_id, keyword), keywords (keyword, text), defined_by (keyword, number), legalities (card_id, format, status), rulings
    (ruling_id, card_id, text, published_at), cites (ruling_id, number), mentions (ruling_id, card_id), rules (number, parent, level, text, pos), references (src, dst),
    formats (name), lexicon as ``linking.lexicon`` makes it.
    """

    cards: DataFrame
    card_keywords: DataFrame
    keywords: DataFrame
    defined_by: DataFrame
    legalities: DataFrame
    rulings: DataFrame
    cites: DataFrame
    mentions: DataFrame
    rules: DataFrame
    references: DataFrame
    formats: DataFrame
    lexicon: DataFrame


@dataclass(frozen=True)
class Retrieval:
    """``outcomes`` (question_id, outcome, route, fallback) and the ``evidence`` kept, with what each template found and kept in ``counts`` (question_id, template, kind, found, kept)."""

    outcomes: DataFrame
    evidence: DataFrame
    counts: DataFrame


def first_rows(rows: DataFrame, keys: list[str], order: list, limit: int, name: str = "item_no") -> DataFrame:
    """The first ``limit`` rows of each key, numbered; Spark cuts them in each task before they are dealt, so a hub sends no more than that from one."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= limit)


def subtree_heads(rules: DataFrame, roots: DataFrame, limit: int, depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """(root, item_no, number, text): the first descendants of each root (number) in document order."""
    tree = descendants(rules, depth).join(roots.select(F.col("number").alias("root")).distinct(), "root", "left_semi")
    return first_rows(tree.join(rules.select("number", "text", "pos"), "number"), ["root"], ["pos"], limit).select("root", "item_no", "number", "text")


def _emitted(rows: DataFrame, emit_no: int, kind: str, key: str, text: str, path: Column, distance: int) -> DataFrame:
    """Evidence rows of one kind; a template's rows follow one another by row, then emit, then item.  Rows without a key are none."""
    number = lambda c: F.col(c) if c in rows.columns else F.lit(0)
    return rows.select(
        "question_id", "call_no", number("row_no").cast("int").alias("row_no"), F.lit(emit_no).alias("emit_no"), number("item_no").cast("int").alias("item_no"),
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"), path.alias("path"), F.lit(distance).alias("distance"),
    ).where("key is not null and key <> ''")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _path(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _of_cards(calls: DataFrame, k: Knowledge) -> DataFrame:
    return calls.select("question_id", "call_no", F.col("key").alias("card_id"), "other").join(k.cards.select("card_id", "name", F.col("text").alias("card_text")), "card_id")


def card_core(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    return _emitted(_of_cards(calls, k), 0, "card", "name", "card_text", _path("card ", F.col("name")), 0)


def _defined(keyed: DataFrame, k: Knowledge, limit: int, distance: int, lead: Column) -> list[DataFrame]:
    """Keywords (question_id, call_no, row_no, keyword) with their texts, defining rules and the first rules below."""
    found = keyed.join(k.keywords.select("keyword", F.col("text").alias("said")), "keyword", "left")
    ruled = keyed.join(k.defined_by, "keyword").join(k.rules.select("number", F.col("text").alias("said")), "number")
    below = ruled.select("question_id", "call_no", "row_no", F.col("number").alias("root")).join(subtree_heads(k.rules, ruled.select("number"), limit), "root")
    return [
        _emitted(found, 0, "keyword", "keyword", "said", _path(lead, F.col("keyword")), distance),
        _emitted(ruled, 1, "rule", "number", "said", _path("keyword ", F.col("keyword"), " > rule ", F.col("number")), distance + 1),
        _emitted(below, 2, "rule", "number", "text", _path("rule ", F.col("root"), " > below"), distance + 2),
    ]


def keyword_definition(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    keyed = calls.select("question_id", "call_no", F.lit(0).alias("row_no"), F.col("key").alias("keyword"))
    known = keyed.join(k.keywords.select("keyword").unionByName(k.defined_by.select("keyword")).distinct(), "keyword", "left_semi")
    return _union(_defined(known, k, limit, 0, F.lit("keyword ")))


def card_legality(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    rows = _of_cards(calls, k).join(k.legalities.withColumnRenamed("format", "other"), ["card_id", "other"])
    return _emitted(rows, 0, "legality", "other", "status", _path("card ", F.col("name"), " > ", F.col("status"), " in ", F.col("other")), 0)


def card_keyword_rules(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    own = first_rows(k.card_keywords.join(calls.select(F.col("key").alias("card_id")).distinct(), "card_id", "left_semi"), ["card_id"], ["keyword"], ROW_LIMIT, "row_no")
    keyed = _of_cards(calls, k).join(own, "card_id").select("question_id", "call_no", "row_no", "keyword")
    return _union(_defined(keyed, k, limit, 1, F.lit("card > keyword ")))


def card_rulings(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    own = k.rulings.join(calls.select(F.col("key").alias("card_id")).distinct(), "card_id", "left_semi")
    own = first_rows(own, ["card_id"], [F.desc("published_at"), F.col("ruling_id")], ROW_LIMIT, "row_no").select("card_id", "row_no", "ruling_id", F.col("text").alias("said"))
    ruled = _of_cards(calls, k).join(own, "card_id")
    cited = ruled.join(k.cites, "ruling_id").join(k.rules.select("number", F.col("text").alias("rule_text"), "pos"), "number")
    cited = first_rows(cited, ["question_id", "call_no", "ruling_id"], ["pos"], limit)
    return _union([
        _emitted(ruled, 0, "ruling", "ruling_id", "said", _path("card ", F.col("name"), " > ruling"), 1),
        _emitted(cited, 1, "rule", "number", "rule_text", _path("ruling > cites"), 2),
    ])


def card_interaction(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    names = k.cards.select("card_id", "name")
    pairs = calls.select("question_id", "call_no", F.col("key").alias("a"), F.col("other").alias("b"))
    pairs = pairs.join(names.select(F.col("card_id").alias("a"), F.col("name").alias("a_name")), "a").join(names.select(F.col("card_id").alias("b"), F.col("name").alias("b_name")), "b")
    asked = pairs.select("a", "b").distinct()
    both = asked.unionByName(asked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # Rulings of the asked hosts that mention the asked others, the first ones of each pair.
    hosted = k.rulings.select("ruling_id", F.col("text").alias("said"), F.col("card_id").alias("a")).join(both.select("a").distinct(), "a", "left_semi")
    said = hosted.join(k.mentions.withColumnRenamed("card_id", "b"), "ruling_id").join(both, ["a", "b"], "left_semi")
    said = first_rows(said, ["a", "b"], ["ruling_id"], limit)
    back = said.select(F.col("a").alias("b"), F.col("b").alias("a"), "ruling_id", "said", "item_no")
    own = k.card_keywords.join(both.select(F.col("a").alias("card_id")).distinct(), "card_id", "left_semi").join(k.defined_by, "keyword")
    one, two = own.select(F.col("card_id").alias("a"), "keyword", "number"), own.select(F.col("card_id").alias("b"), "keyword", "number")
    shared = first_rows(asked.join(one, "a").join(two, ["b", "keyword", "number"]), ["a", "b"], ["keyword", "number"], limit)
    mentioned = lambda x, y: _path("card ", F.col(x), " > ruling > mentions card ", F.col(y))
    return _union([
        _emitted(pairs.join(said, ["a", "b"]), 0, "ruling", "ruling_id", "said", mentioned("a_name", "b_name"), 1),
        _emitted(pairs.join(back, ["a", "b"]), 1, "ruling", "ruling_id", "said", mentioned("b_name", "a_name"), 1),
        _emitted(pairs.join(shared, ["a", "b"]), 2, "rule", "number", "keyword", _path("card ", F.col("a_name"), " > keyword < card ", F.col("b_name")), 2),
    ])


def _of_rules(calls: DataFrame, k: Knowledge) -> DataFrame:
    return calls.select("question_id", "call_no", F.col("key").alias("root")).join(k.rules.select(F.col("number").alias("root"), F.col("text").alias("said")), "root")


def rule_subtree(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    own = _of_rules(calls, k)
    below = own.join(subtree_heads(k.rules, own.select(F.col("root").alias("number")), limit), "root")
    return _union([
        _emitted(own, 0, "rule", "root", "said", _path("rule ", F.col("root")), 0),
        _emitted(below, 1, "rule", "number", "text", _path("rule ", F.col("root"), " > below"), 1),
    ])


def rule_neighbourhood(calls: DataFrame, k: Knowledge, limit: int) -> DataFrame:
    own = _of_rules(calls, k)
    roots, texts = own.select("root").distinct(), k.rules.select("number", "text", "pos")

    def near(root: str, other: str) -> DataFrame:
        links = k.references.select(F.col(root).alias("root"), F.col(other).alias("number")).join(roots, "root", "left_semi").distinct()
        return own.join(first_rows(links.join(texts, "number"), ["root"], ["pos"], limit), "root")

    return _union([
        _emitted(own, 0, "rule", "root", "said", _path("rule ", F.col("root")), 0),
        _emitted(near("src", "dst"), 1, "rule", "number", "text", _path("rule ", F.col("root"), " > refers to"), 1),
        _emitted(near("dst", "src"), 2, "rule", "number", "text", _path("rule ", F.col("root"), " < refers to"), 1),
    ])


RUNS: dict[str, Callable[[DataFrame, Knowledge, int], DataFrame]] = {
    f.__name__: f for f in (card_core, keyword_definition, card_legality, card_keyword_rules, card_rulings, card_interaction, rule_subtree, rule_neighbourhood)
}


def held(k: Knowledge) -> Knowledge:
    """The same tables, with those that most templates read (rules and what leads to them) computed once and at hand of every task where they are few."""
    return replace(k, rules=at_hand(k.rules), references=at_hand(k.references), keywords=at_hand(k.keywords), defined_by=at_hand(k.defined_by), formats=at_hand(k.formats))


def linked(questions: DataFrame, k: Knowledge) -> DataFrame:
    """(question_id, pos, kind, key, ambiguous): what the questions (question_id, question) name."""
    keywords = k.keywords.select(F.col("keyword").alias("name"))
    found = L.link_questions(questions.select("question_id", "question"), k.lexicon, keywords, k.formats, "question_id")
    return found.select("question_id", F.col("at").alias("pos"), "kind", "key", F.col("key").isNull().alias("ambiguous"))


def retrieve(
    questions: DataFrame, k: Knowledge, kind_cap: int = E.KIND_CAP, token_budget: int = E.TOKEN_BUDGET, text_search: bool = True,
    last_resort: Callable[[DataFrame], DataFrame] | None = None,
) -> Retrieval:
    """Evidence of a batch of questions (question_id, question).

    A question with a sure entity is resolved: its entities are asked for by templates; where none of them reaches the rules and no format is named, rules come from a text search with the question and the texts of its cards (without
    ``text_search`` such a question ends as ``no_seed``).  Resolved questions without evidence end as ``no_match``.  ``last_resort`` takes the failed ones (question_id, question, outcome) and returns rows (question_id, item_no, kind, key, text, path, distance);
    what it finds resolves them and is bounded like the rest.  Questions, rules, entities and calls are each computed once (jobs of their own); which templates are asked for is the only thing that reaches the driver.
    """
    questions, k = cut(questions), held(k)
    entities = cut(linked(questions, k))
    sure = entities.where("not ambiguous")
    seeded = L.has_graph_seed(sure, k.card_keywords.select(F.col("card_id").alias("key")), "question_id")
    searches = R.search_calls(questions, entities, seeded)
    calls = cut(R.plan_calls(questions, entities).unionByName(searches))
    asked = {r["template"] for r in calls.select("template").distinct().collect()}
    parts = [RUNS[name](calls.where(F.col("template") == name), k, kind_cap).withColumn("template", F.lit(name)) for name in RUNS if name in asked]
    if text_search and TEXT_SEARCH in asked:
        widened = sure.where("kind = 'card'").select("question_id", F.col("key").alias("card_id")).distinct().join(k.cards, "card_id").select("question_id", "text")
        wanted = calls.where(F.col("template") == TEXT_SEARCH).select("question_id", "call_no")
        # Only rules with a text of their own, not chapters, are searched.
        corpus = k.rules.where("level > 1 and trim(text) <> ''")
        hits = S.search_evidence(corpus, "number", "text", questions.join(wanted, "question_id", "left_semi"), widened)
        parts.append(_searched_rows(hits.join(wanted, "question_id")))
    before = R.outcomes(questions, entities)
    named = entities.where("kind = 'format' and not ambiguous").select("question_id").distinct().withColumn("_f", F.lit(True))
    before = before.join(named, "question_id", "left").join(seeded, "question_id", "left")
    route = F.when(F.col("outcome") == R.RESOLVED, F.when(F.col("_f"), "legality").when(F.col("seeded"), "graph").otherwise(TEXT_SEARCH))
    before = before.select("question_id", "outcome", route.alias("route"))
    if not text_search:
        before = before.withColumn("outcome", F.when(F.col("route") == TEXT_SEARCH, R.NO_SEED).otherwise(F.col("outcome")))
    found = _in_order(_union(parts)) if parts else None
    kept = cut(E.budget(E.cap(found, kind_cap), token_budget)) if parts else None
    some = kept.select("question_id").distinct().withColumn("_some", F.lit(True)) if parts else before.select("question_id", F.lit(None).cast("boolean").alias("_some"))
    after = before.join(some, "question_id", "left")
    after = after.withColumn("outcome", F.when((F.col("outcome") == R.RESOLVED) & F.col("_some").isNull(), R.NO_MATCH).otherwise(F.col("outcome"))).drop("_some").withColumn("fallback", F.lit(False))
    if last_resort is not None:
        after = cut(after)
        failed = after.where(F.col("outcome").isin(R.AMBIGUOUS, R.NO_ENTITIES, R.NO_MATCH)).select("question_id", "outcome")
        more = last_resort(questions.join(failed, "question_id"))
        more = _in_order(more.join(failed.select("question_id"), "question_id", "left_semi").select("question_id", F.lit(0).alias("call_no"), F.lit(0).alias("row_no"), F.lit(0).alias("emit_no"), "item_no", "kind", "key", "text", "path", "distance", F.lit(LAST_RESORT).alias("template")))
        late = cut(E.budget(E.cap(more, kind_cap), token_budget))
        saved = late.select("question_id").distinct().withColumn("_late", F.lit(True))
        after = after.join(saved, "question_id", "left").select("question_id", F.when(F.col("_late"), R.RESOLVED).otherwise(F.col("outcome")).alias("outcome"), "route", F.coalesce("_late", F.lit(False)).alias("fallback"))
        found, kept = (more, late) if found is None else (found.unionByName(more), kept.unionByName(late))
    if found is None:
        empty = _in_order(_searched_rows(questions.sparkSession.createDataFrame([], "question_id long, call_no int, rank int, kind string, key string, text string, path string, distance int")))
        found, kept = empty, E.budget(E.cap(empty, kind_cap), token_budget)
    by = ["question_id", "template", "kind"]
    counts = found.groupBy(*by).agg(F.count(F.lit(1)).alias("found")).join(kept.groupBy(*by).agg(F.count(F.lit(1)).alias("kept")), by, "left").fillna(0, ["kept"])
    return Retrieval(after, kept, counts)


def _searched_rows(hits: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return hits.select("question_id", "call_no", zero.alias("row_no"), zero.alias("emit_no"), F.col("rank").cast("int").alias("item_no"), "kind", "key", "text", "path", "distance", F.lit(TEXT_SEARCH).alias("template"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Evidence rows with their arrival in a question: by call, row, emit and item."""
    w = Window.partitionBy("question_id").orderBy("call_no", "row_no", "emit_no", "item_no", "key")
    return rows.withColumn("arrival", F.row_number().over(w).cast("long")).select("question_id", "arrival", "kind", "key", "text", "template", "path", "distance")


def explain(result: Retrieval) -> DataFrame:
    """(question_id, account): outcome, route, what ran and what was kept, as one text for each question."""
    line = F.format_string("%s %s: %d of %d", "template", "kind", "kept", "found")
    ran = result.counts.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("ran"))
    said = F.concat(F.lit("outcome: "), "outcome", F.lit(" by "), F.coalesce("route", F.lit("nothing")), F.when(F.col("fallback"), " and the last resort").otherwise(""), F.lit("; evidence: "), F.coalesce("ran", F.lit("none")))
    return result.outcomes.join(ran, "question_id", "left").select("question_id", said.alias("account"))
