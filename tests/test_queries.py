"""Every query with SQL agrees with DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from brindle.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    said = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in said.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in said.fetchall()), key=repr)
    assert sorted(names) == cols
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_flagship(spark):
    df = catalogue.flagship(spark, SF)
    assert df.count() > 0 and "tokens" in df.columns


def test_every_query_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == set()


def test_entry_module():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())


def test_rulings_of_the_extraction_report_are_made_once(spark):
    plan = catalogue.queries()["extraction_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Links, citations, a model's candidates and the gate read kept rulings; the tables that they are made of, and contexts that nobody reads, are in no plan that follows.
    assert "l_orderkey" not in plan and "o_orderkey" not in plan and "context" not in plan
