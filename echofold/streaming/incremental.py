"""Streaming counterparts: exact dedup of arrivals, session bursts, journal ingest, cache upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, key: str, time_col: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than ``lateness`` behind the newest row is dropped."""
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, time_col: str, by: str, gap: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Runs of rows of one key with gaps below ``gap``.  A session chains, a burst pair does not."""
    return stream.withWatermark(time_col, lateness).groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def upsert(merge: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str):
    """Starts a query that hands each micro-batch of new analysis rows to ``merge``."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
