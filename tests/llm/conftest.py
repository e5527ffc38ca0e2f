from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, grp int, key string, piece int, row string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "er", "on", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a null id, repeated rows and ids, ties, white space only, other scripts, a long text, columns with clashing names."""
    rng = random.Random(3)
    long = words(rng, 40_000)
    base = words(rng, 120)
    texts = [
        None, "", " \n\t ", "one", "one", "One", base, base, base + " extra", long, long, "x" * 70_000, "é ß 中文 😀 naïve",
        "a  b\n\nc \t d", "mail a.b@c.example.com and +1 (269) 555-3296", "<|endoftext|> and <|startoftext|>", "the " * 200,
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t), "I", "N", 1, "K", 2, "R") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "null id", "en", "s", 7, "I", "N", 1, "K", 2, "R"), (3, "another text of id three", "en", "s", 24, "I", "N", 1, "K", 2, "R")]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    """A few hundred made-up documents with copies, near copies and shared passages."""
    rng = random.Random(5)
    passage, out = words(rng, 60), []
    for _ in range(60):
        base = words(rng, rng.randint(0, 150)).split(" ")
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                if copy:
                    copy[rng.randrange(len(copy))] = words(rng, 1)
            if rng.random() < 0.2:
                copy[len(copy) // 2 : len(copy) // 2] = passage.split(" ")
            out.append(" ".join(copy))
    return spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
