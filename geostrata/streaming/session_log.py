"""The session log as a stream: append-only ingestion of events, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def as_log(events: DataFrame) -> DataFrame:
    """(time, event, item, from, to, note) rows of a table of events, batch or stream."""
    return events.select(F.col("ts").alias("time"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("item"), F.lit("").alias("from"), F.col("value").cast("string").alias("to"), F.col("props").alias("note"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of log rows from a folder of Parquet files."""
    return as_log(spark.readStream.schema(schema).parquet(path))


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of log rows to a folder, once for all that is there."""
    return log.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)


def counts(log: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind; rows later than ``late`` are left out of a stream's state."""
    own = log.withWatermark("time", late) if log.isStreaming else log
    return own.groupBy(F.window("time", every).alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event", "n")
