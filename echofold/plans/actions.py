"""From the groups of a scan to what is done about them: guards, the ordered fold, places, journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policy
from ..operators.contents import ByPath, InColumn
from ..operators.groups import kind_ordinal
from ..options import Options
from ..runtime import Scratch

#: Numbers of the ways of disposal in the journal.
QUARANTINE, RECYCLE_BIN = 0, 1


def guarded(members: DataFrame, fresh: DataFrame, options: Options) -> DataFrame:
    """``members`` of all groups with what the fold looks at: unchanged and keeper_unchanged by a
    ``fresh`` inventory (path, size, last_write), same_file by device and inode, and cross_drive."""
    seen = policy.unchanged(members, fresh.select("path", "size", "last_write"))
    known = F.when(F.col("inode").isNotNull() & (F.col("inode") != 0) & F.col("device").isNotNull(), F.struct("device", "inode"))
    keepers = seen.where("rank = 1").select("group_id", F.col("unchanged").alias("keeper_unchanged"), known.alias("_kept"))
    joined = seen.join(keepers, "group_id").withColumn("same_file", F.coalesce((F.col("rank") > 1) & (known == F.col("_kept")), F.lit(False)))
    return joined.drop("_kept").withColumn("cross_drive", policy.crosses_drives(F.lit(options.quarantine), F.col("path")))


def decide(members: DataFrame, fresh: DataFrame, reader: InColumn | ByPath, options: Options, session: str, decisions: DataFrame | None = None, space: tuple[int, int] | None = None, fixed_drives: tuple[str, ...] = ()) -> DataFrame:
    """The plan of a run, a row per duplicate: what ``policy.execute`` decides, with path, kept_path,
    confidence, method and, for files that go to the quarantine folder ``session``, moved_to.

    Bytes are compared again before a move, except in read-only mode.  A recycle bin takes files
    of fixed drives only; others go to the quarantine.
    """
    scratch = Scratch(members.sparkSession, "decide")
    rows = scratch.cut(guarded(members, fresh, options), "guarded")
    checked = rows.withColumn("still_identical", F.lit(True)) if options.mode == "ReadOnly" else policy.recheck(rows, reader, options)
    done = scratch.cut(policy.execute(scratch.cut(checked, "checked"), options, decisions, space), "done")
    told = rows.where("rank > 1").select("group_id", "file_id", "path", "confidence")
    kept = rows.where("rank = 1").select("group_id", F.col("path").alias("kept_path"))
    plan = done.join(told, ["group_id", "file_id"]).join(kept, "group_id")
    binned = policy.has_bin(F.col("path"), fixed_drives) if options.disposal == "RecycleBin" else F.lit(False)
    plan = scratch.cut(plan.withColumn("method", F.when(F.col("outcome") == "Moved", F.when(binned, RECYCLE_BIN).otherwise(QUARANTINE))), "plan")
    placed = policy.destinations(plan.where(F.col("method") == QUARANTINE), session).select("position", "moved_to")
    return plan.join(placed, "position", "left")


def entries(plan: DataFrame) -> DataFrame:
    """Journal rows of the moves of a plan."""
    return plan.where("outcome = 'Moved'").select(
        F.current_timestamp().alias("TimestampUtc"), F.col("method").alias("Method"), F.col("path").alias("OriginalPath"), F.col("moved_to").alias("MovedTo"), F.col("size").alias("Size"),
        F.col("kept_path").alias("KeptFile"), kind_ordinal(F.col("kind")).alias("Kind"), F.col("confidence").alias("Confidence"), F.col("automatic").alias("Automatic"),
    )


