"""Loading all sources into a store: unchanged ones are skipped by hash, changed ones staged, and everything is put in place by one commit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Manifest, Store
from .evaluation import tree_hash
from .gate import GatedFrame, load_gated
from .graph import assert_unique

REPORT = "source string, table_name string, part string, outcome string, n_rows long, created long, deleted long"
SKIPPED, LOADED = "skipped", "loaded"


@dataclass(frozen=True)
class Source:
    """A source by name and content hash.  ``build`` takes a reader of tables (those staged before it in the same load first) and returns tables by name.

    ``keys`` has the columns that name a row of a table: they are checked to be unique and tell created from deleted rows.  ``parts`` has the column that a table is kept in parts by,
    ``owned`` the parts that are this source's alone: what it no longer brings of them is gone.
    """

    name: str
    sha256: str
    build: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)
    owned: dict[str, tuple[str, ...]] = field(default_factory=dict)
    partial: bool = False


def listing_hash(spark: SparkSession, path: str) -> str:
    """A hash of the files below a path by name, length and time of change: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.lit(0).alias("all"), "path", F.concat_ws("|", F.col("length").cast("string"), F.col("modificationTime").cast("string")).alias("state"))
    found = tree_hash(rows, "all", "path", "state").first()
    return found["sha256"] if found else ""


def _changes(source: str, table: str, new: DataFrame, old: DataFrame | None, keys: tuple[str, ...], by: str | None, parts: list[str]) -> DataFrame:
    """Report rows of a staged table: its rows, and by key those that weren't there and those that no longer are, for each of its parts."""
    part = (F.col(by).cast("string") if by else F.lit("")).alias("part")
    on = [*keys, *([by] if by and by not in keys else [])]
    total = new.sparkSession.createDataFrame([(p,) for p in parts], "part string").join(new.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows")), "part", "left").fillna(0, ["n_rows"])
    if not keys:
        created, deleted = None, None
    elif old is None:
        created, deleted = new.groupBy(part).agg(F.count(F.lit(1)).alias("created")), None
    else:
        if by:  # other parts stay
            old = old.where(F.col(by).cast("string").isin(parts))
        created = new.join(old.select(*on), on, "left_anti").groupBy(part).agg(F.count(F.lit(1)).alias("created"))
        deleted = old.join(new.select(*on), on, "left_anti").groupBy(part).agg(F.count(F.lit(1)).alias("deleted"))
    for name, more in (("created", created), ("deleted", deleted)):
        total = total.withColumn(name, F.lit(0)) if more is None else total.join(more, "part", "left").fillna(0, [name])
    return total.select(F.lit(source).alias("source"), F.lit(table).alias("table_name"), "part", F.lit(LOADED).alias("outcome"), "n_rows", F.col("created").cast("long"), F.col("deleted").cast("long"))


def load_all(store: Store, sources: Sequence[Source], force: bool = False) -> tuple[Manifest, DataFrame]:
    """The manifest after the load and a report (source, table_name, part, outcome, n_rows, created, deleted).

    Sources come in order: a later one may read what an earlier one staged.  A source whose hash the store has is skipped unless ``force``; a partial one is loaded but its hash isn't kept, so the next whole load brings it again.  A table that two sources bring must be
    kept in parts, and each brings its own parts.  Staging, uniqueness and counts are jobs of their own; if any fails nothing is changed.  With nothing to load no manifest is written.
    """
    spark, base = store.spark, store.manifest()
    staged: dict[str, dict] = {}
    hashes: dict[str, str] = {}
    reports: list[DataFrame] = []

    def view(tables: dict) -> Manifest:
        return Manifest(tables=tables)

    def reader(name: str) -> DataFrame:
        return store.read(name, manifest=view(staged) if name in staged else base)

    for s in sources:
        if not force and not s.partial and base.sources.get(s.name) == s.sha256:
            reports.append(spark.createDataFrame([(s.name, "", "", SKIPPED, 0, 0, 0)], REPORT))
            continue
        for name, df in s.build(reader).items():
            by = s.parts.get(name)
            entry = store.stage(name, df, by)
            new = store.read(name, manifest=view({name: entry}))
            keys = s.keys.get(name, ())
            if len(keys) == 1 and by is None:
                assert_unique(new, keys[0])
            old = store.read(name, manifest=base) if name in base.tables else None
            entry["owned"] = list(s.owned.get(name, ()))
            reports.append(_changes(s.name, name, new, old, keys, by, sorted({*entry["parts"], *entry["owned"]})))
            if name in staged:
                if by is None or set(staged[name]["parts"]) & set(entry["parts"]):
                    raise ValueError(f"{s.name} brings {name} again")
                entry = entry | {"parts": {**staged[name]["parts"], **entry["parts"]}, "owned": [*staged[name]["owned"], *entry["owned"]]}
            staged[name] = entry
        if not s.partial:
            hashes[s.name] = s.sha256
    report = spark.createDataFrame([], REPORT)
    for r in reports:
        report = report.unionByName(r)
    # A few rows for each table and part; counted before the commit, against the tables as they were.
    report = spark.createDataFrame(report.collect(), REPORT)
    return (store.commit(base, hashes, staged) if staged else base), report


def load_edges(store: Store, gated: GatedFrame, version: str, table: str = "gated_edge") -> tuple[Manifest, DataFrame]:
    """Put what the gate accepted in place, a part for each edge type; types without accepted edges stay as they are."""
    keys = ("source_key", "target_key")
    source = Source("gate", version, lambda _: {table: load_gated(gated, version)}, {table: keys}, {table: "edge_type"})
    return load_all(store, [source], force=True)
