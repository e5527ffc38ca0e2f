"""Sinks, frozen label sets, tagged fixtures, replays, vocabularies and settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import set_hash
from .evidence import fingerprint


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; null fields are kept, so a line shows every column."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def freeze(labels: DataFrame, key: str, label: str, frozen: str | None) -> str:
    """The hash of a label set, or an error where a frozen hash says otherwise: frozen labels aren't rewritten."""
    now = labels.agg(set_hash(F.col(key), F.col(label)).alias("h")).first()["h"]
    if frozen is not None and now != frozen:
        raise ValueError(f"labels are frozen as {frozen[:12]} and are now {now[:12]}")
    return now


def load_tagged(nodes: DataFrame, rows: DataFrame, key: str, tag: str, name: str) -> DataFrame:
    """``nodes`` with the rows of a fixture, tagged; an error where a key is there already."""
    clash = rows.join(nodes.select(key), key, "left_semi").select(key).limit(5).collect()
    if clash:
        raise ValueError(f"already there, keys are taken: {[r[key] for r in clash]}")
    return nodes.unionByName(rows.withColumn(tag, F.lit(name)), allowMissingColumns=True)


def teardown(nodes: DataFrame, tag: str, name: str) -> DataFrame:
    """``nodes`` without a fixture's rows."""
    return nodes.where(~F.coalesce(F.col(tag) == F.lit(name), F.lit(False)))


def count_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (before, after, delta): proof of what a load or teardown did."""
    a, b = before.agg(F.count(F.lit(1)).alias("n")).scalar(), after.agg(F.count(F.lit(1)).alias("n"))
    return b.select(a.alias("before"), F.col("n").alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def replay_mismatches(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """(question_id, stored, now) where evidence made again hasn't the fingerprint (question_id, sha256) that was stored."""
    now = fingerprint(evidence).withColumnRenamed("sha256", "now")
    both = stored.withColumnRenamed("sha256", "stored").join(now, "question_id", "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("now")))


def answerable_rules(rules: DataFrame, levels: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Rules of the given levels with a text: what a search looks through."""
    return rules.where(F.col("level").isin(*levels) & (F.trim("text") != ""))


def directory(rules: DataFrame, parents: tuple[str, ...], longest: int = 40) -> DataFrame:
    """(number, text) of the rules of level 2 right below given chapters whose text is a short heading."""
    return rules.where((F.col("level") == 2) & F.col("parent").isin(*parents) & (F.length("text") <= longest)).select("number", "text")


def chapters(rules: DataFrame) -> DataFrame:
    """(number, text) of the rules of level 1."""
    return rules.where("level = 1").select("number", "text")


def schema_text(tables: Mapping[str, DataFrame]) -> str:
    """The tables and columns that a generated query may use, a line for each table."""
    return "\n".join(f"{name}({', '.join(f'{c} {t}' for c, t in df.dtypes)})" for name, df in sorted(tables.items()))


def explain_plan(calls: DataFrame) -> DataFrame:
    """(question_id, explanation): the templates that a plan calls, in order, as one line."""
    entry = F.array_sort(F.collect_list(F.struct("call_no", F.concat(F.col("template"), F.lit("("), F.coalesce(F.col("args").cast("string"), F.lit("")), F.lit(")")).alias("said"))))
    return calls.groupBy("question_id").agg(F.array_join(F.transform(entry, lambda x: x["said"]), " -> ").alias("explanation"))


@dataclass(frozen=True)
class Settings:
    """Paths and limits of a run, from the environment where it has them (``BRINDLE_`` and the name in capitals)."""

    data_dir: str = "data"
    budget_tokens: int = 6000
    search_k: int = 8
    extra: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Settings:
        got = {k.removeprefix("BRINDLE_").lower(): v for k, v in env.items() if k.startswith("BRINDLE_")}
        own = {k: type(getattr(cls, k))(got.pop(k)) for k in ("data_dir", "budget_tokens", "search_k") if k in got}
        return cls(**own, extra=got)
