"""Quality rules, conversation trie and ranked search: edge cases, empty tables, and brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import prefix_trie, quality_rules, ranked_search
from brindle.llm._common import shared_warehouse

xxhash = pytest.importorskip("xxhash")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


# --- 11 -------------------------------------------------------------------------------------------------------------


def naive_counts(t):
    t = t or ""
    w, lines = SPLIT.findall(t), [x for x in t.split("\n") if SPLIT.search(x)]
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def hash_of(data, seed=42):
    x = xxhash.xxh64(data, seed=seed).intdigest()
    return x - (1 << 64) if x >> 63 else x


def naive_grams(t):
    h = [hash_of(p.encode()) for p in re.findall("[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0d\x80-\U0010ffff]+", t or "")]
    pairs = [hash_of(struct.pack("<q", b), hash_of(struct.pack("<q", a)) & (1 << 64) - 1) for a, b in zip(h, h[1:])]
    return [x % quality_rules.BUCKETS for x in h + pairs]


def naive_judge(docs, good, loss=0.01):
    fold = {i: hash_of(struct.pack("<q", i)) % quality_rules.HELD_OUT for i in good if i is not None}
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(naive_grams(t))
        if fold.get(i, 0):
            target.update(naive_grams(t))
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    ratio = {}
    for b in raw:
        p = (raw[b] + 1) / (n_raw + size)
        ratio[b] = round(math.log((target[b] + size * p) / (n_target + size) / p), 4) if n_target else 0.0
    scores = [round(sum(ratio[b] for b in g) / len(g), 3) if (g := naive_grams(t)) else 0.0 for _, t in docs]
    held = sorted(s for (i, _), s in zip(docs, scores, strict=True) if fold.get(i) == 0)
    return scores, held[int(loss * len(held))] if held else None


def test_rules_and_scores_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(2)
    rows += [(1000 + i, " ".join(w.upper() + rng.choice(["!!", "###", " |"]) for w in t.split(" "))) for i, t in rows[:40]]
    rows += [(2000, "a b c " * 40), (2001, "a b c d e f\n" * 12 + " \n \n"), (2002, "one two three " + "x" * 60 + " one two three"), (2003, None)]
    good = [i for i, _ in rows if i is not None and i < 1000 and i % 2]
    labels = [(i, 1) for i in good] + [(i, 0) for i in range(0, 60, 2)] + [(good[0], 0), (good[0], 1), (None, 1)]
    scores, cut = naive_judge(rows, set(good))
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for (i, t), s in zip(rows, scores, strict=True):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == naive_counts(t)
        assert r["score"] == pytest.approx(s, abs=0.0011) and r["threshold"] == pytest.approx(cut, abs=0.0011)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= r["threshold"])
    clean = [r for i, r in got.items() if i < 1000 and not r["base_failed"]]
    junk = [r for i, r in got.items() if 1000 <= i < 2000]
    assert sum(r["kept"] for r in clean) > 0.95 * len(clean) and not any(r["kept"] for r in junk)


def test_rules_on_edges_and_without_labels(spark, edge, edge_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.judge(edge, none).collect()
    assert len(rows) == len(edge_rows)
    want = Counter((r[0], *naive_counts(r[1]), not naive_counts(r[1])[-1], 0.0, None) for r in edge_rows)
    assert Counter(tuple(r) for r in rows) == want
    assert quality_rules.judge(empty, none).count() == 0
    some = quality_rules.judge(edge, spark.createDataFrame([(6, 1), (6, 1), (999, 1), (None, 1)], "doc_id long, quality int"))
    assert some.count() == len(edge_rows)


def test_threshold_ties(spark):
    held = spark.createDataFrame([(0.1,)] * 50 + [(0.2,)] * 50 + [(-1.0,)], "score double")
    assert quality_rules.threshold(held, 0.0) == -1.0 and quality_rules.threshold(held, 0.01) == 0.1 and quality_rules.threshold(held, 0.5) == 0.1
    assert quality_rules.threshold(held.where("score > 1"), 0.01) is None


# --- 12 -------------------------------------------------------------------------------------------------------------


def naive_trie(rows, forked=True):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if forked else 0
        seqs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    texts: dict = {}
    seqs = {c: [texts.setdefault(x, len(texts)) for x in v] for c, v in seqs.items()}
    chars = {n: len(x[1]) for x, n in texts.items()}
    nodes = defaultdict(list)
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * chars[k[-1]] if k else 0
    out = []
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


TALK = "conv_id long, turn long, role string, text string, c string, place string, lo int, k1 int"


def talk(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", "p", 1, 2) for r in rows], TALK).repartition(parts)


def found(df):
    return ordered(tuple(r) for r in df.collect())


def test_trie_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice("ab"), rng.choice(["", "x", "yy"])) for c in range(330) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(c, t, "user", "the same talk") for c in range(1000, 1150) for t in range(4)]
    got = prefix_trie.conversation_trie(talk(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == naive_trie(rows)
    assert found(prefix_trie.conversation_trie(talk(spark, rows), forked=False)) == naive_trie(rows, False)


def test_trie_over_several_segments(spark):
    """Conversations that part before, at and after the ends of segments, and end there."""
    n = prefix_trie.SEGMENT
    base = [f"t{i % 7}{i}" for i in range(3 * n)]
    seqs = [base, base[:n], base[: n + 1], base[: n - 1], base[: 2 * n], base[:n] + ["other"] * 5, base[: n + 9] + ["z"], base[: 2 * n] + ["z"], ["q"] * (n + 3), ["q"] * n]
    rows = [(c + 1, t, "r", x) for c, s in enumerate(seqs * 2) for t, x in enumerate(s)]
    assert found(prefix_trie.conversation_trie(talk(spark, rows), forked=False)) == naive_trie(rows, False)
    assert found(prefix_trie.conversation_trie(talk(spark, rows))) == naive_trie(rows)


def test_trie_on_edges(spark):
    rows = [
        (None, 0, "a", "lost"), (0, None, None, None), (0, 1, "user", ""), (0, None, "", ""), (1, 0, "user", "é😀"), (1, 0, "user", "é😀"), (1, None, "b", "z"),
        (-3, 5, "user", "x" * 50_000), (-3, 5, "a", "tie"), (250, 1, None, "alone"), (7, None, None, None), (7, None, None, None),
    ]
    assert found(prefix_trie.conversation_trie(talk(spark, rows), forked=False))[0] is not None
    for forked in (True, False):
        plain = [r for r in rows if r[1] != 5] + [(-3, 5, "user", "x" * 50_000)]  # ties of different turns are in the order of digests
        assert found(prefix_trie.conversation_trie(talk(spark, plain), forked=forked)) == naive_trie(plain, forked)
    assert prefix_trie.conversation_trie(talk(spark, rows[:1])).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TALK)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    # 101 takes its beginning from an absent conversation and loses what it has.
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lone, 0, "a", "b")]
    assert found(prefix_trie.conversation_trie(talk(spark, rows))) == naive_trie(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    rows += [(300, 0, "a", "b")]
    assert found(prefix_trie.conversation_trie(talk(spark, rows))) == naive_trie(rows)


def test_places_over_many_ranges(spark):
    """One conversation's turns, dealt over all ranges, are numbered without gaps."""
    rows = [(1, t, "r", str(t)) for t in range(3000)] + [(2, 0, "r", "x")] * 40
    got = prefix_trie.numbered(talk(spark, rows), "conv_id", "turn", "role", "text").collect()
    assert sorted(r["place"] for r in got if r["c"] == 1) == list(range(1, 3001)) and sorted(r["place"] for r in got if r["c"] == 2) == list(range(1, 41))


def test_digest_of_many_ends(spark):
    n = 3 * prefix_trie.CHUNK_IDS + 5
    ends = spark.range(n).selectExpr("7L as k1", "id % 2 as k2", "id - 1000 as c")
    got = {r["k2"]: r["ends"] for r in prefix_trie.ends_of(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i - 1000) for i in range(n) if i % 2 == k).encode()).hexdigest() for k in (0, 1)}


# --- 13 -------------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def naive_search(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms, df = len(held), sum(n for _, _, n in held), Counter(x for _, c, _ in held for x in c)
    out = []
    for item, t in items:
        ask = Counter(terms(t))
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x, q in ask.items() if x in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return ordered(out)


def test_search_against_brute_force(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(4)
    items = [(i, " ".join(rng.sample(t.split(" "), min(len(t.split(" ")), rng.randint(1, 40)))) * rng.choice([1, 1, 2])) for i, t in rows[::5]]
    items += [(900, None), (901, "..."), (902, "NoSuchTerm"), (3, "the same id"), (3, items[3][1])]
    want = naive_search(rows, items)
    asked = spark.createDataFrame([(*i, "d") for i in items], "item_id long, text string, doc_id string")
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(tuple(r) for r in ranked_search.search(table, asked).collect()) == want
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 60)
    assert ordered(tuple(r) for r in ranked_search.search(table, asked).collect()) == want
    assert ordered(tuple(r) for r in ranked_search.search(table, asked, k=3).collect()) == naive_search(rows, items, 3)


def test_search_on_edges(spark, edge, edge_rows, empty):
    items = [(1, "one the 中文 A.B"), (2, edge_rows[6][1]), (None, "one"), (4, "null ID"), (5, None), (6, "")]
    asked = spark.createDataFrame([(*i, "n") for i in items], "item_id long, text string, id string")
    assert ordered(tuple(r) for r in ranked_search.search(edge, asked).collect()) == naive_search([(r[0], r[1]) for r in edge_rows], items)
    assert ranked_search.search(empty, asked).count() == 0
    none = ranked_search.search(edge, asked.where("item_id = 5"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_treaps_are_search_trees_and_heaps_and_prune():
    rng = np.random.default_rng(1)
    doc, term = np.nonzero(rng.random((400, 6)) < 0.6)
    impact = rng.integers(1, 50, len(doc)) ** 3
    t = ranked_search.Treaps(np.arange(400) * 3, 6, doc, term, impact)
    for top in t.root.tolist():
        stack, seen = [(top, 0, 400)], 0
        while stack:
            p, lo, hi = stack.pop()
            if p < 0:
                continue
            seen += 1
            d = int(t.doc[p])
            assert lo <= d < hi
            for child, a, b in ((int(t.left[p]), lo, d), (int(t.right[p]), d + 1, hi)):
                assert child < 0 or t.impact[child] <= t.impact[p]
                stack.append((child, a, b))
    asked = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 3, 5]), np.array([1, 2, 1, 1, 3])
    best = ranked_search.Best(2, 4)
    scored = ranked_search.traverse(t, *asked, best)
    for q in (0, 1):
        total = np.zeros(400, np.int64)
        for _, x, times in zip(*(a[asked[0] == q] for a in asked), strict=True):
            np.add.at(total, doc[term == x], times * impact[term == x])
        order = np.lexsort((np.arange(400), -total))[:4]
        assert best.id[q].tolist() == (order * 3).tolist() and best.score[q].tolist() == total[order].tolist()
    assert scored < 400  # of some 700 documents with a term


def test_equal_impacts_stay_shallow():
    n = 20_000
    t = ranked_search.Treaps(np.arange(n), 1, np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64))
    best = ranked_search.Best(1, 10)
    ranked_search.traverse(t, np.array([0]), np.array([0]), np.array([1]), best)
    assert best.id[0].tolist() == list(range(10))
    depth, level = 0, np.array([t.root[0]])
    while len(level):
        depth, level = depth + 1, np.concatenate((t.left[level], t.right[level]))
        level = level[level >= 0]
    assert depth < 80


def test_a_local_warehouse_is_no_shared_folder():
    assert shared_warehouse("hdfs://x/warehouse") == "hdfs://x/warehouse" and shared_warehouse("s3a://b/w") == "s3a://b/w"
    for path in ("file:/root/spark-warehouse", "/tmp/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_warehouse(path)
