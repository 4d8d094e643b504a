"""A streaming error timeline: counts per hour and type, late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """A stream over Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type; works on a stream and on a table alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def start(timeline: DataFrame, sink: str, checkpoint: str):
    """Append closed hours to Parquet, exactly once."""
    return timeline.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
