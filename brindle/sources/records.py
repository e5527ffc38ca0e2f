"""Record sources: JSON by content (array, lines, gzip), keyed shards, change manifests and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SUFFIXES = (".jsonl.gz", ".jsonl", ".json")

CARD = (
    "oracle_id string, name string, layout string, cmc double, type_line string, keywords array<string>, mana_cost string, oracle_text string, colors array<string>, "
    "color_identity array<string>, legalities map<string,string>, card_faces array<struct<name: string, mana_cost: string, oracle_text: string, type_line: string, colors: array<string>>>"
)
RULING = "oracle_id string, published_at string, source string, comment string"
GOLDEN = (
    "id string, source string, stratum string, hops int, question string, answer string, gold_entities array<string>, gold_cr_rules array<string>, gold_path string, "
    "vector_should string, vector_should_reason string, rulesguru_url string, snapshot_sha256 string, verified boolean"
)
# Layouts that are no playable cards, and statuses.
SKIPPED_LAYOUTS = ("token", "double_faced_token", "emblem", "art_series", "vanguard", "scheme", "planar")
STATUSES = ("legal", "not_legal", "banned", "restricted")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, folder: str, stem: str) -> str:
    """The first of the known forms of an artifact that exists, on whatever store Spark reads; else the last form's name."""
    for suffix in SUFFIXES:
        if _exists(spark, f"{folder}/{stem}{suffix}"):
            return f"{folder}/{stem}{suffix}"
    return f"{folder}/{stem}{SUFFIXES[-1]}"


def read_json(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """JSON rows of a file: an array if its first character says so, else a value on each line; gzip by suffix.

    Blank lines give no rows.  With ``strict`` a malformed record fails the read.  The first line is read at once, by a job of its own.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    head = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).collect()
    reader = spark.read.schema(schema).option("mode", mode)
    if head and head[0]["v"].startswith("["):
        return reader.option("multiLine", True).json(path)
    return reader.json(path)


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Fail on rows without a required value, naming the column."""
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a record has no {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df


def playable(cards: DataFrame) -> DataFrame:
    """Cards with an id, a name and legalities, of a playable layout, whose type is no token."""
    has = F.coalesce(F.size("legalities"), F.lit(0)) > 0
    named = (F.coalesce("oracle_id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    return cards.where(named & has & ~F.coalesce(F.col("layout").isin(*SKIPPED_LAYOUTS), F.lit(False)) & ~F.coalesce(F.col("type_line").contains("Token"), F.lit(False)))


def read_cards(spark: SparkSession, path: str, playable_only: bool = True, limit: int | None = None) -> DataFrame:
    df = read_json(spark, path, CARD)
    df = playable(df) if playable_only else df
    df = require(df, "oracle_id", "name", "layout", "cmc", "type_line", "legalities")
    return df.limit(limit) if limit is not None else df


def faces(cards: DataFrame) -> DataFrame:
    """(face_key, oracle_id, index, name, ...): a row for each face, keyed by card and place."""
    f = cards.select("oracle_id", F.posexplode("card_faces").alias("index", "f"))
    return f.select(F.concat_ws("#", "oracle_id", "index").alias("face_key"), "oracle_id", "index", "f.*")


def legality_edges(cards: DataFrame) -> DataFrame:
    """(src, dst, status) of a card's legality map; an unknown status fails."""
    e = cards.select(F.col("oracle_id").alias("src"), F.explode("legalities").alias("dst", "status"))
    bad = F.raise_error(F.concat(F.lit("unknown status "), "status")).cast("string")
    return e.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(bad))


def read_golden(spark: SparkSession, *paths: str) -> DataFrame:
    """Golden questions of JSON-lines shards: blank lines and ``//`` comments are skipped, repeated ids fail."""
    lines = spark.read.text(list(paths)).where("trim(value) <> '' and not startswith(ltrim(value), '//')")
    rows = lines.select(F.from_json("value", GOLDEN, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids in more than one place: {sorted(r['id'] for r in twice)}")
    return rows


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def changed_sources(hashes: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Sources whose hash the manifest doesn't have; all of them with ``force``."""
    if force:
        return hashes
    return hashes.join(manifest.select("name", "sha256"), ["name", "sha256"], "left_anti")


def write_snapshot(df: DataFrame, folder: str, version: str) -> DataFrame:
    """Write the next snapshot beside the last one (which may feed ``df``) and read it back."""
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
