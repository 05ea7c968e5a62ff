"""The action journal: JSON lines, appended to and read leniently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "TimestampUtc timestamp, Method int, OriginalPath string, MovedTo string, Size long, KeptFile string, Kind int, Confidence double, Automatic boolean"


def append(entries: DataFrame, path: str) -> None:
    """Adds entries; Spark commits whole files, so a reader never sees half a run."""
    entries.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a journal without blank and malformed lines."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("OriginalPath is not null")
