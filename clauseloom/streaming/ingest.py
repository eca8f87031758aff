"""Structured Streaming: an extension beyond batch parity for query logs and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Table


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, events, total over tumbling windows; rows later than ``late`` behind the watermark are not
    counted. Works on batch and streaming frames."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    got = source.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("window_start"), kind, "events", "total")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user, session_start, session_end, events: a session ends after ``gap`` without an event."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    got = source.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("events"))
    return got.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def first_of_each(rows: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once; on a stream, state is kept as long as the watermark allows repeats."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def upsert_stream(rows: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch into ``table``; a batch that is repeated after a failure changes nothing."""
    return rows.writeStream.foreachBatch(lambda batch, _: table.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The query log as an append-only Parquet table."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
