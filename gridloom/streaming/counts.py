"""Counts kept up to date from a stream of events or links.

Windows close by watermark, so late rows within it still count and state stays bounded; totals
without windows are merged batch by batch into a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) per window; append mode gives each window once, when no late row can change it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def degree_totals(links: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Degrees of the nodes of a stream of (row, col), in one folder a batch; a batch that is repeated writes its folder again."""

    def merge(batch: DataFrame, number: int) -> None:
        ends = batch.select(F.explode(F.array("row", "col")).alias("id"))
        ends.groupBy("id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return links.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_degrees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("id").agg(F.sum("n").alias("degree"))
