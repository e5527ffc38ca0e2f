"""Incremental ingest: a file stream of records that is upserted snapshot by snapshot, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import merge_last


def ingest_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, order: str) -> None:
    """Upsert the source's new JSON files into numbered Parquet snapshots under ``target``, then stop.

    A batch writes the snapshot of its own number from the one before, so a repeated batch writes the same again; what lies before that one is
    removed, so two snapshots stay.
    """
    stream = spark.readStream.schema(schema).json(source)

    def upsert(rows: DataFrame, batch: int) -> None:
        s = rows.sparkSession
        old = s.read.parquet(f"{target}/batch={batch - 1}") if batch else s.createDataFrame([], rows.schema)
        merge_last(old, rows, key, order).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        if batch > 1:
            past = s._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={batch - 2}")
            past.getFileSystem(s._jsc.hadoopConfiguration()).delete(past, True)

    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window with a watermark; works on a stream and on a table."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
