"""Rasters that grow: cell means kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 8) -> DataFrame:
    """Events from parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def cell_means(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(day, r, c, v): mean value by user and day. Days older than the watermark are
    final and leave the state; sums are of whole cents, so order doesn't matter."""
    day = F.window("ts", "1 day")
    cents = F.sum(F.floor(F.col("value") * 100 + 0.5))
    kept = events.withWatermark("ts", late).groupBy(day.alias("day"), F.col("user_id").alias("r")).agg((cents.cast("double") / F.count("*").cast("double")).alias("v"))
    return kept.select(F.col("day.start").alias("day"), "r", F.datediff(F.col("day.start").cast("date"), F.lit("2024-01-01").cast("date")).alias("c"), "v")


def write_cells(cells: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Final cells to parquet, exactly once; with ``once``, all there is and then stop."""
    writer = cells.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").start(path)
