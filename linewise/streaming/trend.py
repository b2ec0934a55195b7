"""Live quality trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _judged(records: DataFrame, time: str, lateness: str) -> DataFrame:
    rows = records.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, lateness) if records.isStreaming else rows


def _shares() -> list[Column]:
    nok = lambda column: F.count_if(F.col(column) == "NOK") / F.count("*")
    return [F.count("*").alias("records"), nok("state_result").alias("state_nok_rate"), nok("tolerance_result").alias("tolerance_nok_rate")]


def live_trend(records: DataFrame, time: str, lateness: str = "2 days", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Record counts and NOK shares by window, sliding by ``slide`` where given; of a stream or of a table.

    As a stream in append mode a window comes out once the watermark, ``lateness`` behind the latest record, has passed its
    end; records behind the watermark are dropped.
    """
    timed = _judged(records, time, lateness)
    return timed.groupBy(F.window(time, width, slide).alias("_w")).agg(*_shares()).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "records", "state_nok_rate", "tolerance_nok_rate"
    )


def live_sessions(records: DataFrame, time: str, keys: Sequence[str], gap: str, lateness: str = "2 days") -> DataFrame:
    """The same figures by session of each ``keys``: records at most ``gap`` apart belong together."""
    timed = _judged(records, time, lateness)
    return timed.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(*_shares()).select(
        *keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "records", "state_nok_rate", "tolerance_nok_rate"
    )
