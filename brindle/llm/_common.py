"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A side is broadcast up to this size (bytes of the table as written, and rows); beyond either the sides meet in a shuffle.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, else the warehouse, if it isn't a local path.

    Only on a local master, where there are no other machines, an unset one is a new temporary folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not root and not current.isEmpty():
        root = current.get()
    if not root:
        root = tempfile.mkdtemp(prefix="brindle-checkpoint-") if sc.master.startswith("local") else shared_warehouse(spark.conf.get("spark.sql.warehouse.dir"))
    if current.isEmpty():
        sc.setCheckpointDir(root)
    return root


def shared_warehouse(path: str) -> str:
    """The warehouse's path, or an error where it is a folder of the driver's own machine, which executors would each write to on theirs."""
    if path.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is a local path")
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job in this block are removed on all executors when the job ends; a lost one is then made anew from its input."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


_TABLES: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_TABLES.items()):
        with suppress(Exception):  # the session's JVM may have gone before
            _delete(spark, path)
    _TABLES.clear()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: a lineage cut with column pruning.

    The table is removed by ``discard``, or when the driver process ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"brindle-{uuid.uuid4().hex}")
    _TABLES[path] = spark
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that no result reads any more."""
    for t in tables:
        path = t._brindle_path
        _delete(t.sparkSession, path)
        _TABLES.pop(path, None)


def small(table: DataFrame) -> DataFrame:
    """A table that ``written`` made, marked for broadcast if its rows and bytes are within the bounds."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table._brindle_path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if size <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS:
        return F.broadcast(table)
    return table


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows, unless the session asks for another number than Spark's default of 10,000.

    Rows are whole texts here: a batch, with its copies in the JVM and in Python, should stay at some megabytes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names: what else ``df`` holds can't clash."""
    text_batches(df.sparkSession)
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in cols.items()])
