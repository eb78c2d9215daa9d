"""Bursts over a stream of events; an extension of the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, keys: list[str], least: int = 3, gap: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """keys, start, end, n of sessions of at least ``least`` events.

    ``end`` is the last event's time plus the gap.  State per open session is one
    row; a session is emitted once the watermark has passed its end (append mode),
    and events later than the watermark are dropped.  Works on batch frames too.
    """
    window = F.session_window(ts, gap)
    found = events.withWatermark(ts, late).groupBy(*keys, window.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= least).select(*keys, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n")
