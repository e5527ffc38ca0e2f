"""Registered queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is the equivalent that DuckDB runs."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _load() -> None:
    from . import annotation_queries, answer_queries, evaluation_queries, extraction_queries, graph_queries, linking_queries, loader_queries, payload_queries, reach_queries, report_queries, retrieval_queries, rules_queries, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every card's keywords and their rules, capped and within a token budget."""
    from pyspark.sql import functions as F

    from ..operators import evidence as E
    from .binding import Tables
    from .graph_queries import keyword_subtrees

    t = Tables(spark, sf_dir)
    rules = keyword_subtrees(t, t.card_keywords())
    rows = t.card_keywords().join(rules, "keyword").withColumn("row_no", F.xxhash64("keyword")).withColumnRenamed("card_id", "question_id")
    emits = [
        {"kind": "keyword", "key": "keyword", "text": "keyword", "path": "concat(number, '/', keyword)"},
        {"kind": "rule", "key": "number", "text": "first_sub", "path": "number", "distance": 1},
    ]
    return E.budget(E.cap(E.emit(rows, "card_keyword_rules", emits)), 6000).select("question_id", "arrival", "kind", "key", "path", "distance", "tokens")


_load()
