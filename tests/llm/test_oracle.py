"""Queries with SQL agree with DuckDB on whole tables: links of near-duplicates (so recall is 1 there) and repeated windows, the trie of conversations and the ranking."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")
queries = pytest.importorskip("brindle.llm.queries")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    said = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in said.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(said.fetchall(), key=repr)
