"""Global order without a global task: numbers and running sums over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch


def running(rows: DataFrame, order: Sequence[str | Column], value: Column, name: str, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows up to and with this one.

    ``order`` must leave no ties.  Rows are dealt out by ranges of the order, which are of like
    size whatever the values, and written; sums run within a range and are offset by the sums of
    the ranges before, of which there are as many as tasks.
    """
    scratch = scratch or Scratch(rows.sparkSession, "running")
    dealt = rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = scratch.cut(dealt, "ranges")
    sums = placed.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    summed = placed.withColumn("_within", within).join(before, "_range")
    return summed.withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_value", "_range", "_within", "_before")


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in an order without ties."""
    return running(rows, order, F.lit(1).cast("long"), name, scratch)


#: Rows of a group beyond which it is a crowd, which one task does not rank or join.
CROWDED = 1 << 14


def crowds(rows: DataFrame, group: str = "group_key", scratch: Scratch | None = None) -> DataFrame | None:
    """(group, _parts) of the groups of over ``CROWDED`` rows, to be broadcast: a row for so many at most; or
    None.  ``rows`` are counted at once."""
    scratch = scratch or Scratch(rows.sparkSession, "crowds")
    many = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED)
    many = scratch.cut(many.select(group, F.ceil(F.col("_n") / CROWDED).cast("int").alias("_parts")), "crowds")
    return many if many.limit(1).count() else None


def by_ranges(rows: DataFrame, group: str, order: Sequence[str | Column], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` of few groups with ``name``: 1, 2, ... within each group in an order without ties, numbered by
    ranges, each group from its first number on."""
    placed = scratch.cut(numbered(rows, [group, *order], "_place", scratch), "crowd")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), group).withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first")


def within(rows: DataFrame, group: str, order: Sequence[str | Column], name: str, many: DataFrame | None, scratch: Scratch) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each group in an order without ties; the crowds ``many`` by ranges."""
    own = F.row_number().over(W.partitionBy(group).orderBy(*order))
    if many is None:
        return rows.withColumn(name, own)
    few, crowd = (rows.join(F.broadcast(many.select(group)), group, how) for how in ("left_anti", "left_semi"))
    return few.withColumn(name, own).unionByName(by_ranges(crowd, group, order, name, scratch))


def with_one(rows: DataFrame, ones: DataFrame, many: DataFrame | None, group: str = "group_key", key: str = "file_id") -> DataFrame:
    """``rows`` joined by group with ``ones``, of which there is a row a group; the crowds ``many`` in parts."""
    if many is None:
        return rows.join(ones, group)
    told, parts = F.broadcast(many), F.coalesce("_parts", F.lit(1))
    left = rows.join(told, group, "left").withColumn("_part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("_parts")
    right = ones.join(told, group, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [group, "_part"]).drop("_part")


def beside(rows: DataFrame, order: Sequence[str | Column], marked: Column, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with position (1, 2, ... in an order without ties) and the positions of the marked rows
    around each: _next and _last strictly after and before it, _first and _final of all (null where there
    is none).

    Carried across ranges: within a range by a window, past its ends by the first and last marked
    position of each range, of which there are as many as tasks.
    """
    scratch = scratch or Scratch(rows.sparkSession, "beside")
    dealt = numbered(rows.withColumn("_marked", F.coalesce(marked, F.lit(False))), order, "position", scratch)
    dealt = dealt.withColumn("_at", F.when(F.col("_marked"), F.col("position"))).repartitionByRange("position").withColumn("_range", F.spark_partition_id())
    placed = scratch.cut(dealt, "beside")
    ranges = placed.groupBy("_range").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    later, sooner = W.orderBy("_range").rowsBetween(1, W.unboundedFollowing), W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    ends = ranges.select("_range", F.min("_lo").over(later).alias("_after"), F.max("_hi").over(sooner).alias("_before"), F.min("_lo").over(every).alias("_first"), F.max("_hi").over(every).alias("_final"))
    own = W.partitionBy("_range").orderBy("position")
    told = placed.withColumn("_in_after", F.min("_at").over(own.rowsBetween(1, W.unboundedFollowing))).withColumn("_in_before", F.max("_at").over(own.rowsBetween(W.unboundedPreceding, -1))).join(ends, "_range")
    return told.withColumns({"_next": F.coalesce("_in_after", "_after"), "_last": F.coalesce("_in_before", "_before")}).drop("_range", "_at", "_marked", "_in_after", "_in_before", "_after", "_before")
