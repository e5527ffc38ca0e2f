"""Loading queries: parts, nations and orders as three sources of one store, loaded twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gate as G
from ..operators import loader
from ..operators.cuts import checkpoint_folder
from ..sources.snapshots import Store
from .binding import Tables, sql
from .catalogue import register
from .text_queries import _JUDGED, _gated

REPORT = "source string, table_name string, part string, outcome string, n_rows long, created long, deleted long"


def _edges(df: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(kind).alias("edge_type"))


def sources(t: Tables, left_out: str) -> list[loader.Source]:
    """Cards, rules and rulings; the rulings' file lacks the orders of one status, and its hash says so."""
    keys, parts = ("src", "dst"), {"edge": "edge_type"}

    def rulings(read) -> dict[str, DataFrame]:
        own = t.rulings().join(t.t("orders").where(F.col("o_orderstatus") != left_out).select(F.col("o_orderkey").alias("ruling_id")), "ruling_id", "left_semi")
        own = own.join(read("card").select("card_id"), "card_id", "left_semi").select("ruling_id", "card_id", "text")
        return {"ruling": own, "edge": _edges(own, "HAS_RULING", "card_id", "ruling_id")}

    return [
        loader.Source("cards", loader.listing_hash(t.spark, f"{t.sf_dir}/part.parquet"), lambda _: {"card": t.cards(), "edge": _edges(t.card_keywords(), "HAS_KEYWORD", "card_id", "keyword")}, {"card": ("card_id",), "edge": keys}, parts, {"edge": ("HAS_KEYWORD",)}),
        loader.Source("rules", loader.listing_hash(t.spark, f"{t.sf_dir}/nation.parquet"), lambda _: {"rule": t.rules(), "edge": _edges(t.rules().where("parent is not null"), "HAS_SUBRULE", "parent", "number")}, {"rule": ("number",), "edge": keys}, parts, {"edge": ("HAS_SUBRULE",)}),
        loader.Source("rulings", loader.listing_hash(t.spark, f"{t.sf_dir}/orders.parquet") + left_out, rulings, {"ruling": ("ruling_id",), "edge": keys}, parts, {"edge": ("HAS_RULING",)}),
    ]


def _loaded(spark: SparkSession, run) -> DataFrame:
    """What ``run`` says of a new store, which is removed afterwards."""
    store = Store(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")
    try:
        return spark.createDataFrame(run(store).collect(), REPORT)
    finally:
        fs, p = store._at("")
        fs.delete(p, True)


def _held(store: Store) -> DataFrame:
    """What the store holds now, counted by table and part."""
    manifest, out = store.manifest(), None
    for name, entry in sorted(manifest.tables.items()):
        part = F.lit("") if entry["by"] is None else F.col(entry["by"])
        n = store.read(name, manifest=manifest).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
        n = n.select(F.lit("store").alias("source"), F.lit(name).alias("table_name"), "part", F.lit("held").alias("outcome"), "n_rows", F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("deleted"))
        out = n if out is None else out.unionByName(n)
    return out


_COUNTS = "n AS (SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS held, count(*) FILTER (WHERE o_orderstatus = 'F') AS new, count(*) FILTER (WHERE o_orderstatus = 'P') AS gone FROM rulings JOIN orders ON o_orderkey = ruling_id)"


@register(
    "load_all_report",
    sql(
        "cards card_keywords rules hosts rulings",
        f", {_COUNTS} SELECT 'cards' AS source, '' AS table_name, '' AS part, 'skipped' AS outcome, 0 AS n_rows, 0 AS created, 0 AS deleted UNION ALL SELECT 'rules', '', '', 'skipped', 0, 0, 0 UNION ALL SELECT 'rulings', 'ruling', '', 'loaded', held, new, gone FROM n UNION ALL SELECT 'rulings', 'edge', 'HAS_RULING', 'loaded', held, new, gone FROM n "
        "UNION ALL SELECT 'store', 'card', '', 'held', count(*), 0, 0 FROM cards UNION ALL SELECT 'store', 'rule', '', 'held', count(*), 0, 0 FROM rules UNION ALL SELECT 'store', 'ruling', '', 'held', held, 0, 0 FROM n UNION ALL SELECT 'store', 'edge', 'HAS_RULING', 'held', held, 0, 0 FROM n "
        "UNION ALL SELECT 'store', 'edge', 'HAS_KEYWORD', 'held', count(*), 0, 0 FROM card_keywords UNION ALL SELECT 'store', 'edge', 'HAS_SUBRULE', 'held', count(*), 0, 0 FROM rules WHERE parent IS NOT NULL",
    ),
)
def load_all_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load, in which one source of three has changed: what was skipped, created and deleted, and what the store then holds."""
    t = Tables(spark, sf_dir)

    def run(store: Store) -> DataFrame:
        loader.load_all(store, sources(t, "F"))
        _, report = loader.load_all(store, sources(t, "P"))
        return report.unionByName(_held(store))

    return _loaded(spark, run)


@register("load_gated_edges", f"WITH {_JUDGED}, a AS (SELECT DISTINCT source_key, target_key FROM g WHERE reason IS NULL) SELECT 'gate' AS source, 'gated_edge' AS table_name, 'MENTIONS' AS part, 'loaded' AS outcome, count(*) AS n_rows, CAST(0 AS BIGINT) AS created, CAST(0 AS BIGINT) AS deleted FROM a HAVING count(*) > 0")
def load_gated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted edges by type, put in place twice: the second load brings the same and creates nothing."""

    def run(store: Store) -> DataFrame:
        gated = _gated(spark, sf_dir)
        loader.load_edges(store, G.GatedFrame(gated.rows), "v1")
        return loader.load_edges(store, gated, "v2")[1]

    return _loaded(spark, run)
