"""Streaming forms: windowed event counts and sessions with a watermark, late rows, and an incremental table scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """``ts`` as a timestamp; on a stream rows later than ``late`` are dropped and state before it is let go."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return seen.withWatermark("ts", late) if seen.isStreaming else seen


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", step: str | None = None) -> DataFrame:
    """Counts and sums per window and event type, windows sliding by ``step`` if given; works on a stream or a table."""
    window = F.window("ts", width, step) if step else F.window("ts", width)
    grouped = _timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``key, start, end, n, total`` of the runs of a key's events with less than ``gap`` between them; ``end`` is the last event's time.

    On a stream open sessions are merged in state, and each is given once, when the watermark has passed its end and gap.
    """
    grouped = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("end"))
    return grouped.select(key, F.col("w.start").alias("start"), "end", "n", "total")


def dropped_late(query) -> int:
    """Rows that a streaming query's stateful operators have dropped as too late, over the progress that it still holds."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def follow(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
