from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions import special
from brindle.operators import evaluation as V
from brindle.operators import evidence as E
from brindle.operators import gate as gating
from brindle.operators import graph as G
from brindle.operators import extraction, guard, linking, router, search, stores


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: [(x is not None, x) for x in t])


# --- evidence rewrites against the sequential rules -------------------------------------------------------------------


def sequential_cap(items, limit):
    seen, counts, kept, capped = set(), {}, [], {}
    for q, arrival, kind, key, template in items:
        ident = (q, template, kind, key)
        if ident in seen:
            continue
        if counts.get((q, template, kind), 0) >= limit:
            capped[q, kind] = capped.get((q, kind), 0) + 1
            continue
        seen.add(ident)
        counts[q, template, kind] = counts.get((q, template, kind), 0) + 1
        kept.append((q, arrival))
    return sorted(kept), capped


def made(spark, seed, n=300):
    rng = random.Random(seed)
    data = [(rng.randint(0, 5), i, rng.choice(["rule", "ruling", "card"]), str(rng.randint(0, 9)), "x" * rng.randint(0, 60), rng.choice("ab"), "p", rng.randint(0, 3)) for i in range(n)]
    return data, spark.createDataFrame(data, "question_id int, arrival long, kind string, key string, text string, template string, path string, distance int")


@pytest.mark.parametrize("seed", [1, 2])
def test_cap_and_its_counts(spark, seed):
    data, df = made(spark, seed)
    kept, capped = sequential_cap([(d[0], d[1], d[2], d[3], d[5]) for d in data], 4)
    assert rows(E.cap(df, 4), "question_id", "arrival") == kept
    # What came again after it was let in isn't counted; what was never let in counts each time.
    assert {(r["question_id"], r["kind"]): r["capped"] for r in E.capped_counts(df, 4).collect()} == capped


@pytest.mark.parametrize("seed", [3, 4])
def test_budget(spark, seed):
    data, df = made(spark, seed)
    want = []
    for q in {d[0] for d in data}:
        mine = [d for d in data if d[0] == q]
        total = sum(max(1, len(d[4]) // 4) for d in mine)
        for d in sorted(mine, key=lambda d: (-d[7], -d[1])):
            if total <= 120:
                break
            total -= max(1, len(d[4]) // 4)
            mine.remove(d)
        want += [(q, d[1]) for d in mine]
    assert rows(E.budget(df, 120), "question_id", "arrival") == sorted(want)


def test_handles(spark):
    df = spark.createDataFrame([(1, 0, "ruling", "a"), (1, 1, "card", "c"), (1, 2, "ruling", "b"), (1, 3, "card", "c")], "question_id int, arrival long, kind string, key string")
    assert rows(E.handles(df), "arrival", "handle") == [(0, "ruling:1"), (1, "card:c"), (2, "ruling:2")]


# --- graph ----------------------------------------------------------------------------------------------------------


def test_tree_is_by_parent_not_prefix(spark):
    rules = spark.createDataFrame([("613", None), ("613.4", "613"), ("613.4a", "613.4"), ("613.41", "613")], "number string, parent string")
    assert rows(G.descendants(rules).where("root = '613.4'"), "number", "distance") == [("613.4a", 1)]
    assert len(G.descendants(rules).where("root = '613'").collect()) == 3
    with pytest.raises(ValueError):
        G.descendants(rules, 4)


def test_ball(spark):
    adj = G.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x")], "src string, dst string"))
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert rows(G.ball(seeds, adj, 2), "node", "distance") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(G.ball(spark.createDataFrame([("x",)], "seed string"), adj, 2), "node", "distance") == [("x", 0)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "old", 0), (2, "two", 0)], "k int, v string, ord int")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, "c", 1)], "k int, v string, ord int")
    once = G.merge_last(old, new, "k", "ord")
    assert rows(once, "k", "v") == [(1, "b"), (2, "two"), (3, "c")]
    assert rows(G.merge_last(once, new, "k", "ord"), "k", "v") == rows(once, "k", "v")
    assert rows(G.merge_first(old.select("k", "v"), new, "k", "ord", "v"), "k", "v") == [(1, "old"), (2, "two"), (3, "c")]
    edges = spark.createDataFrame([("a", "b", "x", 0)], "src string, dst string, m string, ord int")
    more = spark.createDataFrame([("a", "b", "y", 1), ("c", "d", "z", 3), ("c", "d", "w", 2)], "src string, dst string, m string, ord int")
    assert rows(G.insert_only(edges, more, ["src", "dst"], "ord"), "src", "m") == [("a", "x"), ("c", "w")]


def test_prune_keeps_unknown_versions(spark):
    df = spark.createDataFrame([(1, "new"), (2, "old"), (3, None)], "k int, source_sha256 string")
    assert rows(G.prune(df, "new"), "k") == [(1,), (3,)]


def test_version_diff(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, t string"), spark.createDataFrame([(1, "z"), (3, None), (4, "n")], "k int, t string")
    assert rows(G.version_diff(a, b, "k", "t"), "k", "change") == [(1, "reworded"), (2, "withdrawn"), (4, "added")]


def test_unique(spark):
    with pytest.raises(ValueError, match="repeated"):
        G.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


# --- gate -----------------------------------------------------------------------------------------------------------


def test_gate_reasons(spark):
    sources = spark.createDataFrame([("s", "see 100.1 now"), ("t", "other")], "source_key string, text string")
    rules, cards = spark.createDataFrame([("100.1",), ("100.2",)], "number string"), spark.createDataFrame([("c1",)], "card_id string")
    ok = ("CITES_RULE", "s", "100.1", 4, 9, "100.1", "explicit", 0.9)
    cases = [
        (None, ok),
        ("schema_invalid", ("WHAT", *ok[1:])),
        ("schema_invalid", (*ok[:7], 1.5)),
        ("source_not_in_graph", (ok[0], "zz", *ok[2:])),
        ("span_not_verbatim", (*ok[:5], "999.9", *ok[6:])),
        ("mention_unresolved", ("MENTIONS", "s", None, 0, 3, "see", "exact", 0.9)),
        ("card_not_in_graph", ("MENTIONS", "s", "c9", 0, 3, "see", "exact", 0.9)),
        ("rule_not_in_graph", (*ok[:2], "900.1", *ok[3:])),
        ("citation_not_explicit", (*ok[:3], 0, 3, "see", "explicit", 0.9)),
        ("explicit_number_disagrees", (*ok[:2], "100.2", *ok[3:])),
        ("low_confidence", ("MENTIONS", "s", "c1", 0, 3, "see", "exact", 0.3)),
        ("duplicate", (*ok[:7], 0.8)),
    ]
    schema = "ord int, edge_type string, source_key string, target_key string, span_start int, span_end int, span_text string, method string, confidence double"
    df = spark.createDataFrame([(i, *c) for i, (_, c) in enumerate(cases)], schema)
    judged = gating.gate(df, sources, rules, cards)
    assert {r["ord"]: r["reject_reason"] for r in judged.rows.collect()} == {i: w for i, (w, _) in enumerate(cases)}
    assert sum(r["n"] for r in judged.reject_counts().collect()) + judged.accepted().count() == len(cases)
    assert [r["source"] for r in gating.load_gated(judged, "v1").collect()] == ["deterministic"]
    with pytest.raises(TypeError):
        gating.load_gated(df, "v1")


# --- search, linking ------------------------------------------------------------------------------------------------


def test_search(spark):
    corpus = spark.createDataFrame([(1, "flying dragons attack"), (2, "dragons block"), (3, "draw pages")], "k int, text string")
    q = spark.createDataFrame([(1, "Do flying dragons block?"), (2, "zzz"), (3, "")], "question_id int, question string")
    hits = search.search(corpus, "k", "text", q, 2)
    assert rows(hits, "question_id", "k", "rank") == [(1, 1, 1), (1, 2, 2)]
    assert search.significant(hits, 0.99).count() <= 2


def test_lexicon_forms(spark):
    names = spark.createDataFrame([("Wind // Rain", "a"), ("Spark", "b"), ("Ana-Bel's Chest", "c")], "name string, id string")
    lex = linking.lexicon(names, spark.createDataFrame([("The Chest", "c")], "alias string, id string"))
    assert rows(lex, "kind", "key", "target", "face") == sorted([
        ("exact", "wind // rain", "a", False), ("exact", "ana-bel's chest", "c", False), ("loose", "wind rain", "a", False), ("loose", "anabels chest", "c", False),
        ("loose", "the chest", "c", False), ("single", "spark", "b", False), ("single", "wind", "a", True), ("single", "rain", "a", True),
    ])
    cards = spark.createDataFrame([(1, "token"), (2, None), (3, "normal")], "id int, layout string")
    assert rows(linking.rules_entities(cards), "id") == [(2,), (3,)]


def greedy(words, names, longest):
    out, i = [], 0
    while i < len(words):
        n = next((n for n in range(min(longest, len(words) - i), 0, -1) if " ".join(words[i : i + n]) in names), 0)
        if n:
            out.append((i, n, names[" ".join(words[i : i + n])]))
        i += n or 1
    return out


def test_greedy_linking_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["Aa", "Bb", "Cc", "Dd"])
    names = {" ".join(word() for _ in range(rng.randint(2, 4))): i for i in range(14)}
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(80)] + [(80, None), (81, "")]
    lex = linking.lexicon(spark.createDataFrame([(n, i) for n, i in names.items()], "name string, id int"))
    got = linking.link_mentions(spark.createDataFrame(docs, "doc int, text string"), lex, "doc")
    assert rows(got, "doc", "at", "width", "id") == sorted((d, *m) for d, t in docs for m in greedy((t or "").split(), names, 4))


def test_linking_rules(spark):
    names = [("Small Ring", 1), ("Ring of Wind", 2), ("Paper Fold", 3), ("Nap", 4), ("Wind // Rain", 5), ("Twin Name", 6), ("Twin Name", 7), ("Tala's Guard", 8), ("Guard Duty", 9)]
    lex = linking.lexicon(spark.createDataFrame(names, "name string, id int"), spark.createDataFrame([("the ring", 1)], "alias string, id int"))
    texts = [(1, "A small Ring of Wind and paper fold, then Nap", 0), (2, "the Ring, nap Twin Name", 0), (3, "Small Ring does it", 1), (4, "Wind blows", 5)]
    df = spark.createDataFrame(texts, "doc int, text string, host int")
    got = linking.link_mentions(df, lex, "doc", host=df.select("doc", "host"))
    assert rows(got, "doc", "surface", "method", "id") == [(1, "Nap", "single", None), (1, "Wind", "single", None), (1, "small Ring", "exact", 1), (2, "the Ring,", "loose", 1)]
    host = spark.createDataFrame([(1, "The Tala's Guard Duty came")], "doc int, text string")
    found = linking.link_mentions(host, lex, "doc")
    inner = linking.not_within_host(spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 4, 1)], "doc int, at int, width int"), host, spark.createDataFrame([(1, "Tala's Guard")], "doc int, name string"), "doc")
    assert rows(found, "doc", "surface") == [(1, "Tala's Guard")] and rows(inner, "doc", "at", "width") == [(1, 1, 2), (1, 4, 1)]


def test_question_linking(spark):
    names = [("Copper Spark", 1), ("Elder Mage // Copper Spark", 2), ("Here // There", 3), ("Nap", 4), ("Twin Name", 5), ("Twin Name", 6), ("Paper Fold", 7)]
    lex = linking.lexicon(spark.createDataFrame(names, "name string, id int"))
    keywords, formats = spark.createDataFrame([("First strike",), ("Strike",)], "name string"), spark.createDataFrame([("Modern",)], "name string")
    asked = [
        (1, "What does Copper Spark do with first strike, in Modern?"), (2, "is copper spark fine"), (3, "Does rule 613 or 100.2a touch Nap, and Twin Name?"),
        (4, "Tell me about paper fold and Hope"), (5, "I have 100 life"), (6, None),
    ]
    df = spark.createDataFrame(asked, "doc int, question string")
    got = linking.link_questions(df, lex, keywords, formats, "doc")
    out = sorted((r["doc"], r["kind"], r["key"], tuple(r["candidates"])) for r in got.collect() if r["key"]) 
    unsure = sorted((r["doc"], tuple(r["candidates"])) for r in got.collect() if not r["key"])
    assert out == [(1, "card", "1", ()), (1, "format", "Modern", ()), (1, "keyword", "First strike", ()), (3, "card", "4", ()), (3, "rule", "100.2a", ()), (3, "rule", "613", ())]
    assert unsure == [(2, (1,)), (3, (5, 6))]
    seeds = linking.has_graph_seed(got, spark.createDataFrame([("1",)], "key string"), "doc")
    assert rows(seeds, "doc", "seeded") == [(1, True), (2, False), (3, True)]
    strata = linking.mention_stratum(spark.createDataFrame([(1, 1, None), (2, 2, 5)], "doc int, width int, id int"), df.where("doc = 3"), df.where("doc < 5"), "doc")
    assert rows(strata, "doc", "stratum") == [(1, "homonym"), (2, "multiword"), (3, "explicit"), (4, "plain")]


def test_questions_of_one_split_are_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows together again
    df = spark.createDataFrame([(i, f"Does Small Ring {i} work in Modern?") for i in range(400)], "doc int, question string").coalesce(1)
    words = linking.asked_words(df, "doc", "question").select("doc", F.spark_partition_id().alias("p"))
    assert words.distinct().select("p").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_are_built_only_of_widths_that_names_have(spark):
    lex = linking.lexicon(spark.createDataFrame([("Small Ring 17", 1), ("Small Red Fox of Wind", 2)], "name string, id int"), spark.createDataFrame([("Small & Fox", 3)], "alias string, id int"))
    df = spark.createDataFrame([(1, "the Small Ring 17 and Small & Fox, and Small Red Fox of Wind")], "doc int, text string")
    words = df.select("doc", linking.folded_words(F.col("text")).alias("_w"))
    found = linking.windows(words, "doc", linking.first_words(lex, 12), 12)
    # Names that begin with "small" have two, three and five words; "Small & Fox, and" may be one of three.
    assert sorted((r["at"], r["width"]) for r in found.collect()) == [(1, 2), (1, 3), (1, 5), (5, 2), (5, 3), (5, 4), (5, 5), (9, 2), (9, 3), (9, 5)]
    got = linking.link_mentions(df, lex, "doc")
    assert rows(got, "at", "width", "method", "id") == [(1, 3, "exact", 1), (5, 3, "loose", 3), (9, 5, "exact", 2)]


def test_places_in_a_text_are_counted_once_not_for_each_word(spark, monkeypatch):
    monkeypatch.setattr(linking, "STRETCH", 5, raising=False)
    rng = random.Random(2)
    names = {"Aa Bb": 1, "Aa Bb Cc": 2, "Dé & Ee": 3, "Cc": 4}
    lex = linking.lexicon(spark.createDataFrame([(n, i) for n, i in names.items()], "name string, id int"))
    docs = [(i, "  ".join(rng.choice(["Aa Bb", "Aa Bb Cc,", "Dé & Ee", "aa", "Cc", "-", "x"]) for _ in range(i))) for i in range(40)]
    got = linking.link_mentions(spark.createDataFrame(docs, "doc int, text string"), lex, "doc")
    texts = {d: " ".join(t.split()) for d, t in docs}
    found = rows(got, "doc", "at", "width", "start", "surface")
    assert all(texts[d][start:].startswith(said) and len(texts[d][:start].split()) == at and len(said.split()) == width for d, at, width, start, said in found)
    want = sum(len(re.findall(r"Aa Bb Cc|Aa Bb|Dé & Ee|Cc", t)) for t in texts.values())
    assert len(found) == want
    # A function over words that holds a pass over all of them is quadratic; texts now have none but that of their stretches.
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_word_of_every_text_is_looked_up_by_several_tasks(spark):
    lex = linking.lexicon(spark.createDataFrame([("Nap", 1), ("Small Ring", 2)], "name string, id int"))
    found = spark.createDataFrame([(i, "nap", "nap") for i in range(300)] + [(300, "small ring", "small ring")], "doc int, norm string, loose string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = linking._looked_up(found, lex, "doc").select("doc", "method", F.spark_partition_id().alias("p")).collect()
    for k, v in keep.items():
        spark.conf.set(k, v)
    assert sorted((r["doc"], r["method"]) for r in got) == [*((i, "single") for i in range(300)), (300, "exact")]
    assert len({r["p"] for r in got if r["doc"] < 300}) > 1


def test_greedy_pass_against_one_by_one_over_batches():
    rng = random.Random(3)
    given = []
    for d in [None, None, 3, 4, 4, 5, *range(6, 60)]:
        given += sorted((d, rng.randint(0, 12), -rng.randint(1, 4), rng.random() < 0.7) for _ in range(rng.randint(0, 9))) if d != 4 else [(4, 0, -9, True), (4, 3, -2, True), (4, 9, -1, True)]
    given.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2]))
    want, document, free, place = [], 0, 0, None
    for i, (d, at, minus, fits) in enumerate(given):
        if i == 0 or d != document:
            document, free, place = d, 0, None
        if fits and at >= free and place != (at, -minus):
            want.append(i)
            free = at - minus
        place = (at, -minus)
    for size in (1, 2, 7, 1000):
        parts = [given[i : i + size] for i in range(0, len(given), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p], pa.int64()), pa.array([r[1] for r in p], pa.int32()), pa.array([-r[2] for r in p], pa.int32()), pa.array([r[3] for r in p]), pa.array(range(k * size, k * size + len(p)))], list("dawfi")) for k, p in enumerate(parts)]
        assert [i for b in linking._greedy(iter(batches)) for i in b.column(4).to_pylist()] == want


def test_mentions_know_where_they_start_without_a_second_look_at_the_text(spark):
    lex = linking.lexicon(spark.createDataFrame([("Small Ring", 1)], "name string, id int"))
    df = spark.createDataFrame([(1, "Small Ring"), (2, "a  bc, Small  Ring; and Small Ring")], "ruling_id int, text string")
    got = extraction.mention_candidates(df, lex)
    assert rows(got, "source_key", "span_start", "span_end", "span_text") == [("1", 0, 10, "Small Ring"), ("2", 6, 16, "Small Ring"), ("2", 22, 32, "Small Ring")]
    assert " Join Inner, (ruling_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_gate_candidates_without_target_join_by_their_source(spark):
    cols = "ord long, edge_type string, source_key string, target_key string, span_start int, span_end int, span_text string, method string, confidence double"
    cand = [(i, "MENTIONS", str(i), None if i % 2 else "7", 0, 2, "ab", "exact", 1.0) for i in range(40)] + [(50, "CITES_RULE", "0", "100.1", 0, 2, "ab", "llm", 1.0), (51, "MENTIONS", "0", "100.1", 0, 2, "ab", "llm", 1.0)]
    sources = spark.createDataFrame([(str(i), "abc") for i in range(40)], "source_key string, text string")
    got = gating.gate(spark.createDataFrame(cand, cols), sources, spark.createDataFrame([("100.1",), (None,)], "number string"), spark.createDataFrame([("7",), (None,)], "card_id string")).rows
    said = {(r["ord"]): r["reject_reason"] for r in got.collect()}
    assert said == {i: "mention_unresolved" if i % 2 else None for i in range(40)} | {50: None, 51: "card_not_in_graph"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # One join for rules and cards, on a key that is never null, and one for sources.
    assert plan.count("Join LeftOuter") == 2 and "coalesce(target_key" in plan


def test_citations_of_one_rule_are_judged_by_several_tasks(spark, monkeypatch):
    cols = "ord long, edge_type string, source_key string, target_key string, span_start int, span_end int, span_text string, method string, confidence double"
    cand = [(i, "CITES_RULE", str(i), ("100.1", "999.1")[i % 2], 0, 2, "ab", "llm", 1.0) for i in range(200)] + [(200, "MENTIONS", "0", "7", 0, 2, "ab", "llm", 1.0), (201, "REFERENCES", "0", "7", 0, 2, "ab", "llm", 1.0)]
    given = [spark.createDataFrame(cand, cols), spark.createDataFrame([(str(i), "abc") for i in range(200)], "source_key string, text string")]
    given += [spark.createDataFrame([("100.1",)], "number string"), spark.createDataFrame([("7",)], "card_id string")]
    want = {i: "rule_not_in_graph" if i % 2 else None for i in range(200)} | {200: None, 201: "rule_not_in_graph"}
    for most in (10_000, 0):
        monkeypatch.setattr(gating, "MOST_RULES", most, raising=False)
        got = gating.gate(*given).rows
        assert {r["ord"]: r["reject_reason"] for r in got.collect()} == want
    assert "_deal" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_meets_a_key_of_many_targets_once(spark):
    lex = linking.lexicon(spark.createDataFrame([("Twin Name", i) for i in range(50)] + [("Twin-Name Sir", 60), ("Twinname Sir", 61)], "name string, id int"))
    found = spark.createDataFrame([(1, "twin name", "twin name"), (2, "twin-name sir", "twinname sir")], "doc int, norm string, loose string")
    got = linking._looked_up(found, lex, "doc")
    assert sorted((r["doc"], r["rank"], r["method"], len(r["ids"])) for r in got.collect()) == [(1, 0, "exact", 50), (2, 0, "exact", 1), (2, 1, "loose", 2)]
    # A run that is exact for two cards isn't saved by its loose form.
    hits = spark.createDataFrame([(1, 0, 2, False, 0), (1, 0, 2, True, 1), (1, 0, 1, True, 2)], "doc int, at int, width int, ok boolean, rank int")
    assert rows(linking.without_overlaps(hits, "doc", fits=F.col("ok"), rank=F.col("rank")), "doc", "at", "width") == [(1, 0, 1)]


# --- evaluation -----------------------------------------------------------------------------------------------------


def test_prf(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc int, item string")
    pred = spark.createDataFrame([(1, "a"), (1, "x"), (9, "q")], "doc int, item string")
    r = V.prf(V.pair_counts(gold, pred, "doc", "item")).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 2, 0.4)


def test_mcnemar(spark):
    df = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    assert abs(V.mcnemar(df, "a", "b").first()["p_value"] - 0.109375) < 1e-6
    assert V.mcnemar(df.where("a and b"), "a", "b").first()["p_value"] == 1.0
    assert V.rule_of_three(0) == 1.0 and V.rule_of_three(30) == 0.1


def test_sign_test_against_exact_sums(spark):
    for n in (1, 2, 7, 31, 120, 701):
        for k in {0, 1, n // 7, n // 3, n // 2 - 1, n // 2} - {-1}:
            want = min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n))) if 2 * k != n else 1.0
            assert special.paired_sign_test(k, n - k) == pytest.approx(want, rel=1e-11)
            assert special.paired_sign_test(n - k, k) == special.paired_sign_test(k, n - k)
    # A billion pairs: near the normal's tails, with the correction for continuity.
    for z in (1.0, 2.5, 6.0):
        n = 10**9
        k = int(n / 2 - z * math.sqrt(n) / 2)
        assert special.paired_sign_test(k, n - k) == pytest.approx(math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 2)), rel=1e-6)
    assert special.paired_sign_test(0, 5000) == 0.0 and special.paired_sign_test(5, 5) == special.paired_sign_test(0, 0) == 1.0
    df = spark.createDataFrame([("x", True, False), ("x", True, False), ("y", True, True)], "g string, a boolean, b boolean")
    assert rows(V.mcnemar(df, "a", "b", "g"), "g", "only_a", "only_b", "p_value") == [("x", 2, 0, 0.5), ("y", 0, 0, 1.0)]


def test_allocation(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, n_rows long")
    assert rows(V.allocate(counts, "s", 4), "s", "quota") == [("a", 2), ("b", 1), ("c", 1)]
    assert rows(V.allocate(counts, "s", 10), "s", "quota") == [("a", 5), ("b", 3), ("c", 2)]


def test_derangement_has_no_fixed_point(spark):
    df = spark.range(40).select((F.col("id") % 7).alias("g"), "id", F.col("id").alias("v"))
    out = V.derangement(df, "g", "id", "v", 3)
    assert out.where("v = shuffled").count() == 0 and out.select("shuffled").distinct().count() == out.count()


def test_bootstrap_brackets_the_point(spark):
    c = spark.createDataFrame([(str(i), i % 3, 3) for i in range(12)], "cluster string, x long, y long")
    r = V.bootstrap_ratio(c, "x", "y", 200).first()
    assert r["low"] <= r["point"] <= r["high"]


def test_bootstrap_of_any_statistic(spark):
    """Against the same draws one by one; the plan has no row for a cluster and a resample."""
    data = [(str(i), float(i % 5), float(i * i % 11)) for i in range(25)] + [("n", None, 2.0)]
    df = spark.createDataFrame(data, "k string, x double, y double").repartition(3)
    got = V.bootstrap(df, "k", {"x": F.col("x"), "y": F.col("y"), "n": F.lit(1)}, lambda s: s["x"] * s["y"] / (s["n"] * s["n"]), 300, 7)
    said = got.first()
    values = []
    for b in range(300):
        w = [sum(int(hashlib.md5(f"7|{b}|{k}".encode()).hexdigest()[:8], 16) >= bound for bound in V._POISSON) for k, _, _ in data]
        if sum(w):
            values.append(sum(c * (x or 0) for c, (_, x, _) in zip(w, data, strict=True)) * sum(c * y for c, (_, _, y) in zip(w, data, strict=True)) / sum(w) ** 2)
    values.sort()
    want = (sum(x or 0 for _, x, _ in data) * sum(y for _, _, y in data) / len(data) ** 2, values[int(0.025 * len(values))], values[min(len(values) - 1, int(0.975 * len(values)))])
    assert tuple(said) == pytest.approx(want, abs=1e-6)
    assert V.bootstrap(df.where("false"), "k", {"x": F.col("x")}, lambda s: s["x"], 20).first()["low"] is None


def test_order_statistics_of_uneven_values(spark):
    """One value with nearly all rows, a tail over hundreds of magnitudes, negative values, two distinct values, whole numbers."""
    data = [("one", 3.5)] * 5000 + [("one", float(i)) for i in range(50)] + [("tail", 10.0**e) for e in range(-150, 150)] + [("two", -1.0)] * 7 + [("two", 2.0)] * 6
    df = spark.createDataFrame(data, "g string, v double")
    places = {"low": lambda n: F.floor((n - 1) / 2), "p95": V.quantile_at(0.95), "last": lambda n: n - 1}
    for bins in (64, 4096):
        got = {r["g"]: tuple(r)[1:] for r in V.order_statistics(df, "g", "v", places, bins).collect()}
        for g in ("one", "tail", "two"):
            v = sorted(x for k, x in data if k == g)
            assert got[g] == (len(v), v[(len(v) - 1) // 2], v[min(len(v) - 1, int(len(v) * 0.95))], v[-1])
    whole = V.order_statistics(spark.range(1000).select(F.lit("w").alias("g"), (F.col("id") % 37).alias("v")), "g", "v", places, 8).first()
    assert tuple(whole)[1:] == (1000, *(sorted(i % 37 for i in range(1000))[k] for k in (499, 950, 999)))


def test_order_statistics(spark):
    rng = random.Random(5)
    data = [(g, v) for g in ("a", "b", None) for v in [rng.gauss(0, 1) ** 3 for _ in range(501)] + [0.25] * 200] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p95": V.quantile_at(0.95), "first": lambda n: n * 0}
    for bins in (1, 7, 4096):
        got = {r["g"]: tuple(r)[1:] for r in V.order_statistics(df, "g", "v", places, bins).collect()}
        for g in ("a", "b", None, "one"):
            v = sorted(x for k, x in data if k == g)
            n = len(v)
            assert got[g] == (n, v[(n - 1) // 2], v[n // 2], v[min(n - 1, int(n * 0.95))], v[0])
        assert len(got) == 4
    assert V.order_statistics(df.where("false"), "g", "v", places).count() == 0


def test_hashes_of_sets(spark):
    df = spark.createDataFrame([("s", i, "x" if i % 2 else None) for i in range(50)], "g string, k int, v string")
    turned = df.orderBy(F.desc("k"))
    for of in (lambda d: d.groupBy("g").agg(V.set_hash(F.col("k"), F.col("v")).alias("sha256")), lambda d: V.tree_hash(d, "g", "k", "v")):
        assert rows(of(df), "sha256") == rows(of(turned), "sha256") != rows(of(df.where("k > 0")), "sha256")


def test_stratified_draw_by_parts(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("s"), "id")
    quotas = spark.createDataFrame([("hot", 7), ("cold", 200), ("gone", 1)], "s string, quota long")
    few, one = (V.stratified_draw(df, quotas, "s", "id", 3, salts) for salts in (8, 1))
    assert rows(few, "s", "id") == rows(one, "s", "id") and few.count() == 107


# --- router, guard --------------------------------------------------------------------------------------------------


def test_plans(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    e = spark.createDataFrame([(1, 0, "card", "A", False), (1, 1, "card", "B", False), (1, 2, "format", "modern", False), (2, 0, "card", "C", True)], "question_id int, pos int, kind string, key string, ambiguous boolean")
    assert {r["question_id"]: r["outcome"] for r in router.outcomes(q, e).collect()} == {1: router.RESOLVED, 2: router.AMBIGUOUS, 3: router.NO_ENTITIES}
    calls = [(r["template"], r["key"], r["other"]) for r in router.plan_calls(q, e).orderBy("call_no").collect()]
    assert calls[0] == ("card_core", "A", None) and ("card_legality", "B", "modern") in calls and ("card_interaction", "A", "B") in calls
    assert len(calls) == 9


def test_search_fallback(spark):
    """Only resolved questions that reach no rule and name no format are searched for; an ambiguous name beside a sure one stops nothing."""
    q = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "question_id int")
    e = spark.createDataFrame([(1, 0, "card", "A", False), (2, 0, "card", "C", True), (4, 0, "format", "modern", False), (5, 0, "card", "C", True), (5, 4, "card", "B", False), (5, 9, "card", "B", False)], "question_id int, pos int, kind string, key string, ambiguous boolean")
    seeded = spark.createDataFrame([(1, True)], "question_id int, seeded boolean")
    assert rows(router.outcomes(q, e), "question_id", "outcome") == [(1, router.RESOLVED), (2, router.AMBIGUOUS), (3, router.NO_ENTITIES), (4, router.RESOLVED), (5, router.RESOLVED)]
    assert rows(router.search_calls(q, e, seeded), "question_id", "template") == [(5, "text_search")]
    assert rows(router.plan_calls(q, e).where("question_id = 5"), "template", "key") == [("card_core", "B"), ("card_keyword_rules", "B"), ("card_rulings", "B")]


def test_replies(spark):
    replies = [("a", "one two three", 'sure: [{"quote": "two", "rule": "613.4"}, {"quote": "six", "rule": "1"}, {"quote": " ", "rule": "1"}, {"quote": "one"}]'), ("b", "x", "no list"), ("c", "x", None)]
    got = router.parsed_replies(spark.createDataFrame(replies, "ruling_id string, text string, reply string"))
    assert rows(got, "ruling_id", "start", "end", "reason") == [("a", None, None, "quote_not_in_text"), ("a", 0, 3, "no_rule"), ("a", 3, 4, "no_quote"), ("a", 4, 7, None), ("b", None, None, "unparsed"), ("c", None, None, "unparsed")]
    said = router.answer(router.RESOLVED, "b", "q", lambda q, b: "It does [rule:1; ruling:9] and [rule:1].", frozenset({"rule:1"}))
    assert said["unknown"] == ["ruling:9"]


def test_answers():
    assert router.answer(router.NO_MATCH, "", "q", None)["refused"]
    assert router.answer(router.RESOLVED, "b", "q", lambda q, b: "yes")["text"] == "yes"
    assert router.answer(router.RESOLVED, "b", "q", lambda q, b: "CANNOT ANSWER")["refused"]


@pytest.mark.parametrize(
    ("query", "reason"),
    [
        ("select 1 as key, 'x' as text -- drop", "comment"),
        ("select 1 as key, 'x' as text; drop table t", "several"),
        ("drop table t", "opener"),
        ("with a as (select 1) insert into t select * from a", "write clause insert"),
        ("select :p as key, 'x' as text", "unbound"),
        ("select (1 as key, text", "syntax"),
        ("select key, text from nowhere_at_all", "analysis"),
        ("select 1 as key", "no column text"),
        ("select reflect('java.lang.System', 'exit', 1) as key, 'x' as text", "function reflect"),
        ("select java_method('java.lang.Runtime', 'x') as key, 'x' as text", "function java_method"),
        ("select key, text from parquet.`/tmp/x`", "direct file"),
        ("select key, text from `parquet`.`/tmp/x`", "direct file"),
        ("select input_file_name() as key, 'x' as text", "function input_file_name"),
        ("select key, text from read_files('/tmp/x')", "function read_files"),
    ],
)
def test_guard_refuses(spark, query, reason):
    with pytest.raises(guard.Refusal, match=reason):
        guard.validated(spark, query)


def test_guard_allows_plain_names(spark):
    q = "with t(k, v) as (select id, 'a' from range(3)) select k as key, upper(v) as text, 1 as set, 2 as load, 3 as add from t where k in (0, 2)"
    assert rows(guard.validated(spark, q), "key", "text", "set") == [(0, "A", 1), (2, "A", 1)]


@pytest.mark.parametrize(
    ("query", "reason"),
    [
        ("select key, text from (select * from (select key, text from csv.`/etc/x`))", "direct file"),
        ("select 1 as key, (select max(value) from text.`/etc/x`) as text", "direct file"),
        ("with a as (select * from json.`x`) select key, text from a", "direct file"),
        ("select 1 as key, 'a' as text where exists (select 1 from orc.`hdfs://x`)", "direct file"),
        ("select key, text from sql_keywords()", "function sql_keywords"),
        ("select 1 as key, x as text from range(1) lateral view stack(2, 1, 2) t as x", "function stack"),
        ("select 1 as key, (select current_user()) as text", "function current_user"),
        ("select 1 as key, transform(array(1), x -> java_method('a', 'b')) as text", "function java_method"),
        ("select 1 as key, system.builtin.reflect('a', 'b') as text", "function"),
        ("select key, text from guarded distribute by key", "clause"),
        ("select key, text from elsewhere", "table elsewhere"),
        ("with a as (select 1) merge into t using a on true when matched then delete", "write clause|syntax|clause"),
    ],
)
def test_guard_walks_the_plan(spark, query, reason):
    spark.range(3).selectExpr("id as key", "'t' as text").createOrReplaceTempView("guarded")
    spark.range(3).selectExpr("id as key", "'t' as text").createOrReplaceTempView("elsewhere")
    with pytest.raises(guard.Refusal, match=reason):
        guard.validated(spark, query, frozenset({"guarded"}))


def test_guard_looks_at_what_names_mean(spark):
    """Aliases, columns and strings that look like clauses or functions are none; the whole of a query is walked and let through."""
    spark.range(6).selectExpr("id as key", "concat('delete from t', id) as text", "id % 2 as `insert`").createOrReplaceTempView("guarded")
    q = """with `merge`(key, n, delete) as (select key, count(*) over (partition by `insert` order by key), text as delete from guarded where text like '%delete from%')
        select m.key as key, nullif(upper(left(delete, 3)), 'x') as text, case when n > 1 then 'reflect(1)' else 'drop table t' end as `create`, cast(key as string) as `update`, element_at(transform(array(n), x -> x + 1), 1) as t, key::int as i
        from `merge` m where key in (select max(key) from guarded group by `insert`) and exists (select 1 from guarded g where g.key = m.key) order by key limit 5"""
    assert rows(guard.validated(spark, q, frozenset({"guarded"})), "key", "text", "create", "t") == [(4, "DEL", "reflect(1)", 4), (5, "DEL", "reflect(1)", 4)]
    assert guard.validated(spark, "select key, text from guarded union all select key, text from guarded g join (select key as k from guarded) on k = key lateral view explode(array(1, 2)) e as x").count() == 18


def test_guard_limits(spark):
    assert guard.validated(spark, "select id as key, 'drop; --' as text from range(500) limit 900").count() == 200
    assert guard.validated(spark, "select id as key, 'x' as text from range(500);").count() == 50


# --- extraction, stores -----------------------------------------------------------------------------------------------


def test_extraction_pipeline(spark):
    rulings = spark.createDataFrame([("r1", "See  rule 613.4a with Small Ring and Nap here", "c9"), ("r2", "Rule 999.1 is gone", None), ("r3", None, None)], "ruling_id string, text string, host string")
    lex = linking.lexicon(spark.createDataFrame([("Small Ring", "c1"), ("Nap", "c2")], "name string, id string"))
    rules, cards = spark.createDataFrame([("613.4a",)], "number string"), spark.createDataFrame([("c1",), ("c2",)], "card_id string")
    gated, report = extraction.extract(rulings, lex, rules, cards)
    assert rows(gated.accepted(), "edge_type", "source_key", "target_key", "span_text") == [("CITES_RULE", "r1", "613.4a", "613.4a"), ("MENTIONS", "r1", "c1", "Small Ring")]
    assert rows(report, "edge_type", "outcome", "n") == [("CITES_RULE", "accepted", 1), ("CITES_RULE", "rule_not_in_graph", 1), ("MENTIONS", "accepted", 1), ("MENTIONS", "mention_unresolved", 1)]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "id string, label int")
    path = str(tmp_path / "lines")
    stores.write_json_lines(df, path)
    assert rows(spark.read.schema(df.schema).json(path), "id", "label") == [("a", None), ("b", 2)]
    full = df.na.fill(0)
    mark = stores.freeze(full, "id", "label", None)
    assert stores.freeze(full.orderBy("label"), "id", "label", mark) == mark
    with pytest.raises(ValueError, match="frozen"):
        stores.freeze(full.withColumn("label", F.lit(9)), "id", "label", mark)
    assert "id string" in stores.schema_text({"t": df}) and stores.chapters(spark.createDataFrame([("1", 1, "A"), ("2", 2, "B")], "number string, level int, text string")).count() == 1
    ev = spark.createDataFrame([("q1", 1, "rule", "1", "t", "x", "p", 0), ("q2", 1, "rule", "1", "t", "x", "p", 0)], "question_id string, arrival long, kind string, key string, text string, template string, path string, distance int")
    from brindle.operators import evidence as E

    stored = E.fingerprint(ev)
    assert stores.replay_mismatches(ev, stored).count() == 0
    assert rows(stores.replay_mismatches(ev.withColumn("text", F.when(F.col("question_id") == "q2", "u").otherwise(F.col("text"))), stored), "question_id") == [("q2",)]
    assert rows(stores.answerable_rules(spark.createDataFrame([("1", 2, " "), ("2", 2, "x"), ("3", 1, "y")], "number string, level int, text string")), "number") == [("2",)]
    tagged = spark.createDataFrame([("a", "f"), ("b", None)], "id string, tag string")
    assert rows(stores.teardown(tagged, "tag", "f"), "id") == [("b",)]
    with pytest.raises(ValueError, match="already there"):
        stores.load_tagged(tagged, spark.createDataFrame([("b",)], "id string"), "id", "tag", "g")
    assert stores.load_tagged(tagged, spark.createDataFrame([("c",)], "id string"), "id", "tag", "g").count() == 3


# --- migration, annotations -----------------------------------------------------------------------------------------


def test_migration_verdicts(spark):
    from brindle.operators import migration

    old = [("100.1", "the same words as ever stand here"), ("100.2", "these words will be changed a little bit"), ("100.3", "a rule that moves to the next chapter"), ("100.4", "gone for good without any trace at all")]
    new = [("100.1", old[0][1]), ("100.2", old[1][1] + "!"), ("100.3", "something else entirely now"), ("101.7", old[2][1]), ("109.1", old[3][1])]
    to = lambda rows: spark.createDataFrame(rows, "number string, text string")
    got = {r["number"]: (r["verdict"], r["target"]) for r in migration.judge(to(old), to(new)).collect()}
    assert got == {"100.1": ("unchanged", "100.1"), "100.2": ("edited", "100.2"), "100.3": ("relocated", "101.7"), "100.4": ("orphaned", None)}
    cites = spark.createDataFrame([(1, "100.3"), (2, "100.1"), (3, "9.9")], "r int, rule_number string")
    moved = migration.apply_moves(cites, migration.judge(to(old), to(new)))
    assert rows(moved, "r", "rule_number", "verdict") == [(1, "101.7", "relocated"), (2, "100.1", "unchanged"), (3, "9.9", "unknown")]
    assert migration.word_diff("a b c", "a x c") == "a [-b-] {+x+} c"


def test_annotations(spark):
    from brindle.operators import annotations as A

    known = spark.createDataFrame([("1.1",)], "number string")
    df = spark.createDataFrame([("a", ["1.0"], True), ("b", None, False)], "k string, cites array<string>, verified boolean")
    assert [r["cites"] for r in A.add_citation(df, "k", "a", "cites", "1.1", known).orderBy("k").collect()] == [["1.0", "1.1"], None]
    with pytest.raises(ValueError, match="no known rule"):
        A.add_citation(df, "k", "a", "cites", "9", known)
    with pytest.raises(ValueError, match="no cites yet"):
        A.require_done(df, "cites")
    assert [r["k"] for r in A.publishable(df, F.lit(True), "k").collect()] == ["a"]
    with pytest.raises(ValueError, match="not valid"):
        A.publishable(df, F.col("cites").isNull(), "k")
    assert A.blind(df, "cites").where("cites is not null").count() == 0
    tagged = spark.createDataFrame([("a", None)], "k string, tag string")
    more = A.load_tagged(tagged, spark.createDataFrame([("z",)], "k string"), "k", "t1")
    assert rows(A.teardown(more, "t1"), "k") == [("a",)]
    with pytest.raises(ValueError, match="taken"):
        A.load_tagged(more, spark.createDataFrame([("a",)], "k string"), "k", "t1")
    assert [r[0] for r in df.select(A.canonical(F.array(F.lit("1.1."), F.lit(" 1.1")))).collect()] == [["1.1"], ["1.1"]]


@pytest.mark.parametrize("most", [10_000, 1])
def test_runs_of_words_by_first_words_and_without(spark, monkeypatch, most):
    monkeypatch.setattr(linking, "MOST_FIRST_WORDS", most)
    docs = spark.createDataFrame([(1, "a b c a b  c d"), (2, "a b"), (3, None), (4, ""), (5, "x y z\na\tb c")], "doc int, text string")
    lex = spark.createDataFrame([("p", "a b c"), ("q", "b c d"), ("r", "y z a"), ("p", "x y q")], "item string, surface string")
    assert rows(linking.ngram_mentions(docs, lex, "doc", "item", 3), "doc", "item", "start_word") == [(1, "p", 0), (1, "p", 3), (1, "q", 4), (5, "p", 3), (5, "r", 1)]


def test_search_sums_pairs_where_they_are_made(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('common words of tale', id % 7, ' a', repeat('b', cast(id % 11 as int))) as text")
    questions = spark.createDataFrame([(1, "common tales"), (2, "abbb words"), (3, "")], "question_id long, question string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = search.search(docs, "doc_id", "text", questions)
        got = sorted(map(tuple, near.collect()))
        plan = near._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(search, "MOST_ASKED", 0, raising=False)
        assert got == sorted(map(tuple, search.search(docs, "doc_id", "text", questions).collect())) and len(got) == 16
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # Pairs are never dealt out, and texts aren't cut into terms once more by a filter on their number.
    assert not re.search(r"hashpartitioning\(question_id#\d+L?, doc_id", plan) and "size(array_distinct" not in plan


def test_recall_groups_rows_by_their_number(spark, monkeypatch):
    gold = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None), (2, 5), (None, 1)], "doc long, item long")
    found = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, 9), (2, 5), (3, 1), (None, 1)], "doc long, item long")
    monkeypatch.setattr(V, "MOST_ROWS", 1, raising=False)
    got = V.retrieval_recall(gold, found, "doc", "item")
    assert {r["doc"]: round(r["recall"], 6) for r in got.collect()} == {1: 0.333333, 2: 1.0, None: 0.0}
    # As many tasks as rows with both columns named, and no join of both sides, which would sort them.
    assert got.rdd.getNumPartitions() == 11 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
