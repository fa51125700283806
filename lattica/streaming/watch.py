"""Debounced refresh from a log of file events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.config import VaultConfig
from lattica.sources.vault import keep_files


def debounce(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds", key: str | None = None) -> DataFrame:
    """(started, ended, events, paths): sessions of ``events(ts, path)`` that end after ``gap`` without an event.

    One session over all events, or one per value of ``key``. Works on streams, with watermark ``late``, and on tables.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    # a stream's sessions need a second key; this one is 0 for every row, but no literal that the optimizer would drop
    same = F.coalesce(F.pmod(F.length("path"), F.lit(1)), F.lit(0)).alias("_all")
    groups = events.groupBy(F.session_window("ts", gap), key or same)
    out = groups.agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select(*([key] if key else []), F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events", "paths")


def watch(events: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "2 seconds", config: VaultConfig = VaultConfig()) -> StreamingQuery:
    """Starts a query that calls ``refresh(paths, batch)`` with the distinct paths of each finished session.

    ``events(ts, path, dest_path)``: of a move the destination counts. Stop it with ``query.stop()``; progress is kept in ``checkpoint``.
    """
    moved = events.withColumn("path", F.coalesce("dest_path", "path")) if "dest_path" in events.columns else events
    sessions = debounce(keep_files(moved, config), gap)

    def each(batch: DataFrame, number: int) -> None:
        paths = batch.select(F.explode("paths").alias("path")).distinct()
        if paths.take(1):
            refresh(paths, number)

    return sessions.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).start()
