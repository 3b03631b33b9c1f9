"""Streams: sessions of events, debounced paths, and writes of micro-batches. Each has a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(events: DataFrame, gap_seconds: int) -> DataFrame:
    g = events.groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("w"), "user_id")
    return g.agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def batch_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(user_id, events, first_ms, last_ms): runs of a user's events without a longer gap."""
    return _fold(events.select("ts", "user_id"), gap_seconds).select("user_id", "events", F.unix_millis(F.col("first").cast("timestamp")).alias("first_ms"), F.unix_millis(F.col("last").cast("timestamp")).alias("last_ms"))


def stream_sessions(events: DataFrame, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: sessions are emitted once the watermark has passed their end."""
    return _fold(events.select("ts", "user_id").withWatermark("ts", late), gap_seconds).select("user_id", "events", F.unix_millis(F.col("first").cast("timestamp")).alias("first_ms"), F.unix_millis(F.col("last").cast("timestamp")).alias("last_ms"))


def debounced_paths(changes: DataFrame, quiet: str = "750 milliseconds", late: str = "5 seconds") -> DataFrame:
    """(project_id, ended, paths): the distinct changed paths of each burst of a project; a burst ends with a quiet gap.
    (ts, project_id, path)"""
    w = changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "project_id")
    return w.agg(F.sort_array(F.collect_set("path")).alias("paths")).select("project_id", F.col("w.end").alias("ended"), "paths")


def observe(changes: DataFrame, open_sessions: DataFrame, shown: int = 12) -> DataFrame:
    """(session_id, kind, detail): a burst's paths as an event of every open session of its project; a stream joined
    with a table. (project_id, paths) x (project_id, session_id)"""
    more = F.size("paths") - shown
    text = F.concat(F.array_join(F.slice("paths", 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return changes.join(open_sessions, "project_id").select("session_id", F.lit("file_change").alias("kind"), text.alias("detail"))


def index_sink(stream: DataFrame, update, checkpoint: str):
    """Runs ``update(batch, batch_id)`` for each micro-batch, one at a time; none is dropped while one is busy."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
