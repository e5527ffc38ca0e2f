"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def staged(spark):
    from brindle.llm._common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def test_stages(staged):
    from test_training_operators import brute_components

    docs, mild, single, clean, private, packed = staged
    names = docs.columns
    assert all(x.columns == names for x in staged[:-1])
    assert mild.count() <= docs.count()
    rows = [(r["doc_id"], r["text"]) for r in mild.collect()]
    groups = brute_components(rows, 5)
    kept = {r["doc_id"] for r in single.collect()}
    by = {}
    for d, _, c, _ in groups:
        by.setdefault(c, set()).add(d)
    assert all(len(kept & g) == 1 for g in by.values()) and len(kept) == len(by)
    assert clean.count() < single.count()
    assert private.count() == clean.count()
    assert all(r["n_chars"] == len(r["text"]) for r in private.collect())
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in private.collect()}


def test_benchmark_passages_go(spark, staged):
    _, _, single, clean, _, _ = staged
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in single.collect() if any(i in r["text"].lower() for i in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert held and not held & left


def test_near_duplicate_stage_with_null_and_repeated_ids(spark):
    text = "a b c d e f g h i j k"
    docs = spark.createDataFrame([(None, text, "x"), (None, text, "x"), (1, text, "x"), (1, "other words in this text are here", "x"), (2, None, "x"), (2, "", "x")], "doc_id long, text string, lang string")
    out = pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(["", "None", text, "other words in this text are here"])


def test_stages_with_odd_tables(spark, tmp_path):
    """Empty tables, null and very long texts, repeated rows and columns with clashing names pass all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row0 string, id string, node string, label string"
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    some = [(1, None), (None, ""), (2, long), (2, long), (None, None), (3, "one two three four five six seven"), (4, "call +1 555 123 4567 now please do")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], some):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d") for i, t in rows], schema)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), schema)
        assert out.count() >= len(rows) - 1
        if rows:
            assert docs.count() == len(rows) - 1 and any("[PHONE]" in (r["text"] or "") for r in docs.collect())
            assert {r["row0"] for r in docs.collect()} == {"a"}
