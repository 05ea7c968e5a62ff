"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import options as K
from ..functions import text


def report_rows(members: DataFrame, language: str = "en") -> DataFrame:
    """KEEP and duplicate rows of numbered groups in the columns of the CSV report."""
    keep, dup = ("KEEP", "duplicate") if language == "en" else ("TENERE", "doppione")
    first = F.col("rank") == 1
    return members.select(
        F.col("group_id").alias("group"), F.when(first, keep).otherwise(dup).alias("role"), text.kind_label(F.when(first, F.col("group_kind")).otherwise(F.col("kind")), language).alias("kind"),
        F.when(first, "").otherwise(F.format_string("%.0f", "confidence")).alias("confidence"), text.reason_in(F.when(first, F.col("keeper_reason")).otherwise(F.col("reason")), language).alias("reason"), "path",
        F.col("size").alias("size_bytes"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"),
        F.coalesce(F.substring(F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss.SS"), 1, 22), F.lit("")).alias("taken_at"), F.format_string("%.0f", F.coalesce("sharpness", F.lit(0.0))).alias("sharpness"), F.col("rank").alias("_rank"),
    )


def kind_summary(groups: DataFrame) -> DataFrame:
    """Groups and reclaimable bytes per kind, and the total (kind null)."""
    return groups.rollup("kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("reclaimable_bytes").cast("long").alias("bytes"))


def kind_stats(groups: DataFrame) -> DataFrame:
    """Groups per kind with zeros for kinds that do not occur."""
    dim = groups.sparkSession.createDataFrame(list(enumerate(K.KINDS)), "kind_ord int, kind string")
    counted = groups.groupBy("kind").agg(F.count(F.lit(1)).alias("_n"))
    return dim.join(counted, "kind", "left").select("kind_ord", "kind", F.coalesce("_n", F.lit(0)).alias("groups"))


def media_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(~F.col("is_video")).alias("photos"), F.count_if("is_video").alias("videos"), F.count_if(F.col("error").isNotNull()).alias("unreadable"), F.coalesce(F.sum(F.when(F.col("full_hash").isNull(), F.col("size"))), F.lit(0)).cast("long").alias("bytes_to_hash"))
