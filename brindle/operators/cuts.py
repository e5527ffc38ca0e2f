"""Lineage cuts for tables that several plans read: checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``; only on a local master an unset one is a new temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="brindle-checkpoint-")
    sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder (a job of its own)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_hand(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` computed once as :func:`cut` does, and broadcast where it has at most ``most`` rows (counted), so what meets it isn't shuffled."""
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept
