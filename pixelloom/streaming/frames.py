"""Streams: frames folded as they arrive, documents that stay incomplete, and events binned into heat maps by time.

All state is that of Spark's own aggregations, in the state store; what has an event time is freed when the watermark passes. The
same functions over a batch give what the stream ends with: that is how a canvas is replayed when its state is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_canvas(patches: DataFrame) -> DataFrame:
    """Fold patches ``(doc_id, item_index, x, y, v)`` that replace: each pixel's value of the highest item so far.

    Items may arrive in any order; a pixel changes only for a later one, and of several values of one item the largest counts. In
    update mode the output is what changed.
    """
    best = patches.groupBy("doc_id", "x", "y").agg(F.max(F.struct("item_index", "v")).alias("last"))
    return best.select("doc_id", "last.item_index", "x", "y", "last.v")


def arrived(items: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``doc_id, start, frames, complete`` of documents whose items ``(ts, doc_id, item_index, item_count)`` arrive one by one.

    A document ends when no item came for ``gap`` and the watermark, ``late`` behind, has passed; one with fewer different items than
    it should have is kept with ``complete`` false, as a truncated file keeps the frames already read. Append mode gives each document once.
    """
    found = items.withWatermark("ts", late).groupBy("doc_id", F.session_window("ts", gap).alias("session"))
    counted = found.agg(F.size(F.collect_set("item_index")).alias("frames"), F.max("item_count").alias("item_count"))
    return counted.select("doc_id", F.col("session.start").alias("start"), "frames", (F.col("frames") >= F.col("item_count")).alias("complete"))


def heat_map(events: DataFrame, rows: int = 48, every: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events ``(ts, user_id)`` counted by window of time (a column of the map) and user row, late ones within ``late``.

    Windows tumble or, with ``slide``, overlap.
    """
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    counted = events.withWatermark("ts", late).groupBy(window, (F.col("user_id") % rows).cast("int").alias("y")).agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("v"))
    return counted.select(F.col("window.start").alias("start"), "y", "v")


def visits(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``user_id, start, stop, n``: runs of a user's events without a pause of ``gap``."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
