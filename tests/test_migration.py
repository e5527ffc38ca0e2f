"""Migration of citations against all pairs, and how many pairs are compared."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from brindle.operators import migration as M

WORDS = "whenever a player casts this spell that creature gains flying until end of turn and loses control of each permanent they own if no other effect says so".split()


def table(spark, rows):
    return spark.createDataFrame(rows, "number string, text string").repartition(3)


def order(number):
    chapter, _, rest = number.partition(".")
    return int(chapter), int("".join(c for c in rest if c.isdigit()) or 0), number


def brute(old, new):
    now, out = dict(new), {}
    for number, text in old:
        if "." not in number:
            there = any(n.startswith(number + ".") for n in now)
            out[number] = ("unchanged" if there else "orphaned", number if there else None)
            continue
        if not text:
            out[number] = ("orphaned", None)
            continue
        if now.get(number) == text:
            out[number] = ("unchanged", number)
            continue
        ratio = lambda b: SequenceMatcher(None, text, b).ratio()
        same = ratio(now[number]) if number in now else 0.0
        chapter = int(number.split(".")[0])
        near = [(ratio(t), n) for n, t in new if "." in n and t and n != number and abs(int(n.split(".")[0]) - chapter) <= 2]
        best = min(near, key=lambda x: (-x[0], order(x[1])), default=(0.0, None))
        if best[0] >= 0.90 and best[0] >= same + 0.15:
            out[number] = ("relocated", best[1])
        else:
            out[number] = ("edited", number) if number in now else ("orphaned", None)
    return out


def some_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, k):
    chars = list(text)
    for _ in range(k):
        i = rng.randrange(len(chars))
        if rng.random() < 0.5:
            chars.insert(i, rng.choice("xyzé "))
        elif len(chars) > 1:
            del chars[i]
    return " ".join("".join(chars).split())


def test_verdicts_against_all_pairs(spark):
    rng = random.Random(8)
    old = [(f"{100 + i // 12}.{i % 12}", some_text(rng, rng.choice([1, 1, 2, 4, 12, 30, 60]))) for i in range(150)]
    new = []
    for number, text in old:
        chapter, _, rest = number.partition(".")
        what = rng.random()
        k = rng.choice([0, 1, 2, len(text) // 30, len(text) // 12, len(text) // 8])
        if what < 0.3:
            new.append((number, edited(rng, text, k)))
        elif what < 0.7:
            new.append((f"{int(chapter) + rng.choice([-2, -1, 1, 2, 3])}.{rest}{rng.choice('abcd')}", edited(rng, text, k)))
            if rng.random() < 0.5:
                new.append((number, some_text(rng, 10)))
        elif what < 0.9:
            new.append((number, text))
    new = [(n, t) for n, t in dict(new).items() if t]
    old += [("101", "Chapter"), ("999", "Chapter"), ("100.77", ""), ("100.78", "ab"), ("100.79", "abcde"), ("130.1", "alone")]
    new += [("101.78", "ab"), ("102.79", "abcdef"), ("101.80", "zz")]
    got = {r["number"]: (r["verdict"], r["target"]) for r in M.judge(table(spark, old), table(spark, new)).collect()}
    want = brute(old, new)
    assert got == want
    assert {v for v, _ in want.values()} == {"unchanged", "edited", "relocated", "orphaned"} and sum(v == "relocated" for v, _ in want.values()) > 20


def test_candidates_stay_few_when_a_chapter_grows(spark):
    rng = random.Random(3)
    old = [(f"100.{i}", some_text(rng, 30)) for i in range(20)]
    moved = [(f"101.{i}", edited(rng, t, 4)) for i, (_, t) in enumerate(old)]
    letters = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwz0123456789 ") for _ in range(150))
    sizes = []
    for more in (0, 600):
        new = moved + [(f"101.{1000 + i}", " ".join(letters().split())) for i in range(more)]
        pairs = M.candidates(table(spark, old).withColumnRenamed("text", "was"), table(spark, new).toDF("target", "now")).collect()
        assert {(n, "101" + n[3:]) for n, _ in old} <= {tuple(p) for p in pairs}
        sizes.append(len(pairs))
    assert sizes[1] <= sizes[0] + 20  # of 12,000 pairs more


def test_citations_and_diffs(spark):
    old, new = [("100.1", "one two three four five six"), ("100.2", "gone with all that it said")], [("100.1", "one two 3 four five six")]
    verdicts = M.judge(table(spark, old), table(spark, new))
    cites = spark.createDataFrame([(1, "100.1"), (1, "100.1"), (2, "100.1"), (3, "100.2"), (4, "7.7")], "ruling_id int, rule_number string")
    said = sorted((r["number"], r["verdict"], r["n_rulings"], r["needs_review"]) for r in M.citing(verdicts, cites).collect())
    assert said == [("100.1", "edited", 2, True), ("100.2", "orphaned", 1, True)]
    pairs = spark.createDataFrame([("a b c", "a x c"), (None, "n")], "was string, now string")
    assert [r["diff"] for r in M.with_diff(pairs, "was", "now").collect()] == ["a [-b-] {+x+} c", "{+n+}"]
    assert M.judge(table(spark, old).where("false"), table(spark, new)).count() == 0
