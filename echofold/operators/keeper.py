"""Which copy of a group stays, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..runtime import Scratch
from .ranking import by_ranges


def in_preferred(path: Column, root: Column, preferred: tuple[str, ...]) -> Column:
    """Whether a file lies in a folder to keep and not in a more specific folder added inside it."""
    out = F.lit(False)
    for p in preferred:
        inside = F.coalesce((F.length(root) > 0) & names.is_under(root, F.lit(p)) & ~names.same_folder(root, F.lit(p)), F.lit(False))
        out = out | (F.coalesce(names.is_under(path, F.lit(p)), F.lit(False)) & ~inside)
    return out


def order(preferred: tuple[str, ...] = ()) -> list[Column]:
    """Best first: folder to keep, pixels, metadata, no copy or edit marker, oldest, shortest
    path; the path, then the id, end every tie."""
    return [
        F.desc("_preferred"), F.desc("_pixels"), F.desc_nulls_last("richness"), F.asc("has_copy"), F.asc("has_edit"), F.asc("last_write"), F.length("path").asc(), F.upper("path").asc(), F.asc("file_id"),
    ]


def burst_order() -> list[Column]:
    """Sharpest first, then pixels and metadata."""
    return [F.desc_nulls_last("sharpness"), F.desc("_pixels"), F.desc_nulls_last("richness"), F.upper("path").asc(), F.asc("file_id")]


def choose(members: DataFrame, group: str = "group_key", burst: str | None = None, preferred: tuple[str, ...] = (), many: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``members`` with rank (1: the keeper) and keeper_reason (on the keeper's row).

    ``burst`` names a Boolean column that is true for the groups ranked as bursts; ``many`` has the groups
    that are ``ranking.crowds``.
    """
    is_burst = F.col(burst) if burst else F.lit(False)
    rows = members.withColumn("_preferred", in_preferred(F.col("path"), F.col("root"), preferred)).withColumn("_pixels", F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0)))
    stats = lambda agg, c: agg(F.when(F.col("rank") > 1, F.col(c)))
    told = {
        "_max_sharp": stats(F.max, "sharpness"), "_max_pixels": stats(F.max, "_pixels"), "_max_rich": stats(F.max, "richness"), "_any_copy": stats(F.bool_or, "has_copy"),
        "_min_write": stats(F.min, "last_write"), "_all_pref": stats(F.bool_and, "_preferred"), "_n": F.count(F.lit(1)),
    }
    by = W.partitionBy(group)
    ranked = F.when(is_burst, F.row_number().over(by.orderBy(*burst_order()))).otherwise(F.row_number().over(by.orderBy(*order(preferred))))
    few = rows if many is None else rows.join(F.broadcast(many.select(group)), group, "left_anti")
    few = few.withColumn("rank", ranked).withColumns({c: value.over(by) for c, value in told.items()})
    if many is None:
        return _reasoned(few, is_burst)
    crowd = rows.join(F.broadcast(many.select(group)), group, "left_semi")
    scratch = scratch or Scratch(members.sparkSession, "keepers")
    placed = by_ranges(crowd.where(~is_burst), group, order(preferred), "rank", scratch)
    if burst:
        placed = placed.unionByName(by_ranges(crowd.where(is_burst), group, burst_order(), "rank", scratch))
    sums = placed.groupBy(group).agg(*[value.alias(c) for c, value in told.items()])  # a row a crowd
    return _reasoned(few, is_burst).unionByName(_reasoned(placed.join(F.broadcast(sums), group), is_burst))


def _reasoned(rows: DataFrame, is_burst: Column) -> DataFrame:
    # The reasons are texts of the report.
    reason = (
        F.when(F.col("_n") == 1, "")
        .when(is_burst & (F.col("sharpness") > F.col("_max_sharp")), "the sharpest shot")
        .when(F.col("_preferred") & ~F.col("_all_pref"), "it is in the folder to keep")
        .when(F.col("_pixels") > F.col("_max_pixels"), "higher resolution")
        .when(F.col("richness") > F.col("_max_rich"), "richer metadata (date, GPS...)")
        .when(~F.col("has_copy") & F.col("_any_copy"), 'original name, without "(1)" or "Copy"')
        .when(F.col("last_write") <= F.col("_min_write"), "the oldest copy")
        .otherwise("shorter path")
    )
    return rows.withColumn("keeper_reason", F.when(F.col("rank") == 1, reason)).drop(*[c for c in rows.columns if c.startswith("_")])
