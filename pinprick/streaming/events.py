"""The time-ordered operators over a stream of events (ts, key columns, value).

State is bounded by the watermark: rows later than it are dropped, windows and sessions are
given out once it has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_per_frame(stream: DataFrame, width: str = "1 hour", *, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Count of each tumbling window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("frame_start"), "n")


def rolling_rate(stream: DataFrame, width: str = "1 hour", slide: str = "10 minutes", *, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Count of each sliding window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("frame_start"), "n")


def on_periods(stream: DataFrame, key: str, gap: str = "1 hour", *, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sessions of each key: runs of events less than ``gap`` apart."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("on_start"), F.col("w.end").alias("on_end"), "n")
