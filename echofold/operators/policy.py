"""Action plans, undo plans and the review table as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import options as K
from ..functions.text import drive, quarantine_path
from ..options import Options
from ..runtime import Scratch
from .contents import FULL, PARTIAL, SAMPLE, ByPath, InColumn
from .groups import change_keeper
from .ranking import beside, numbered, running


def is_automatic(kind: Column, confidence: Column, options: Options) -> Column:
    """Whether a member is handled without a question in the mode of the options."""
    if options.mode == "SemiAutomatic":
        return kind == "ExactBytes"
    if options.mode == "Automatic":
        return (confidence >= options.effective_threshold) & (kind != "Burst")
    return F.lit(False)


def is_low(free: Column, total: Column, adding: Column) -> Column:
    """Whether less than a tenth of the disk would stay free."""
    return free - adding < total * K.MIN_FREE_FRACTION


def unchanged(scan: DataFrame, fresh: DataFrame) -> DataFrame:
    """The scanned files with unchanged: the path still exists with its size and time."""
    now = fresh.select(F.upper("path").alias("_p"), F.col("size").alias("_s"), F.col("last_write").alias("_t"))
    joined = scan.join(now, F.upper(scan["path"]) == F.col("_p"), "left")
    return joined.withColumn("unchanged", F.coalesce((F.col("_s") == F.col("size")) & (F.col("_t") == F.col("last_write")), F.lit(False))).drop("_p", "_s", "_t")


def move_plan(members: DataFrame, options: Options, journal: DataFrame | None = None) -> DataFrame:
    """What happens to each duplicate, in order: group_id, seq, file_id, automatic, outcome.

    Guards in order: already handled, keeper not available (moved before, or changed), changed
    since the scan, same file as the keeper; then Planned, or AwaitingReview if not automatic.
    Columns used: group_id, rank, file_id, keeper_id, kind, confidence, size, unchanged,
    keeper_unchanged, same_file.
    """
    moved = journal.select(F.col("file_id").alias("_m")).distinct() if journal is not None else members.sparkSession.createDataFrame([], "_m long")
    dups = members.where("rank > 1").join(moved, F.col("file_id") == F.col("_m"), "left")
    kept = moved.withColumnRenamed("_m", "_km")
    dups = dups.join(kept, F.col("keeper_id") == F.col("_km"), "left")
    automatic = is_automatic(F.col("kind"), F.col("confidence"), options)
    outcome = (
        F.when(F.col("_m").isNotNull(), "AlreadyHandled")
        .when(F.col("_km").isNotNull() | ~F.col("keeper_unchanged"), "KeeperUnavailable")
        .when(~F.col("unchanged"), "ChangedSinceScan")
        .when(F.col("same_file"), "SameFile")
        .when(automatic, "Planned")
        .otherwise("AwaitingReview")
    )
    seq = F.row_number().over(W.partitionBy("group_id").orderBy("rank", "file_id"))
    return dups.select("group_id", seq.cast("long").alias("seq"), "file_id", "keeper_id", "kind", "confidence", "size", automatic.alias("automatic"), outcome.alias("outcome"))


def space_guard(plan: DataFrame, free: int, total: int) -> DataFrame:
    """The planned moves with QuarantineFull from the first that would leave too little space on:
    after it everything waits."""
    planned = plan.where("outcome = 'Planned'")
    used = running(planned, ["group_id", "seq"], F.col("size"), "used_after")
    full = is_low(F.lit(free).cast("long"), F.lit(total).cast("long"), F.col("used_after"))
    return used.withColumn("outcome", F.when(full, "QuarantineFull").otherwise("Moved"))


def _asked(members: DataFrame, decisions: DataFrame, options: Options) -> DataFrame:
    """``members`` with automatic, and choice: what was answered for those that need a question.

    Answers (group_id, choice: Apply, ApplyToAllOfThisKind, Skip, Quit) count in group order: after
    an ApplyToAllOfThisKind groups of its kind whose questions are all sure enough are taken without
    one, and from a Quit on nothing is done."""
    automatic = is_automatic(F.col("kind"), F.col("confidence"), options)
    least = F.min(F.when(~F.col("automatic"), F.col("confidence"))).over(W.partitionBy("group_id"))
    marked = members.withColumn("automatic", automatic).withColumn("_least", least).join(decisions.select("group_id", F.col("choice").alias("_own")), "group_id", "left")
    kinds = marked.where("_own = 'ApplyToAllOfThisKind' and _least is not null").groupBy(F.col("group_kind").alias("_kind")).agg(F.min("group_id").alias("_from"))
    joined = marked.join(F.broadcast(kinds), F.col("group_kind") == F.col("_kind"), "left")  # a row a kind
    approved = F.coalesce((F.col("_from") < F.col("group_id")) & (F.col("_least") >= K.SAME_KIND_FLOOR), F.lit(False))
    quit_at = joined.where((F.col("_own") == "Quit") & F.col("_least").isNotNull() & ~approved).agg(F.min("group_id")).first()[0]
    late = F.lit(False) if quit_at is None else (F.col("group_id") > quit_at) | ((F.col("group_id") == quit_at) & ~F.col("automatic"))
    own = F.when(F.col("_own") == "ApplyToAllOfThisKind", "Apply").otherwise(F.col("_own"))
    choice = F.when(late, "Wait").when(F.col("automatic") | approved, "Apply").otherwise(F.coalesce(own, F.lit("Wait")))
    return joined.withColumn("choice", choice).drop("_own", "_kind", "_from", "_least")


def execute(members: DataFrame, options: Options, decisions: DataFrame | None = None, space: tuple[int, int] | None = None) -> DataFrame:
    """What a run does to every duplicate, as an ordered fold over groups and members: columns
    group_id, position, file_id, keeper_id, kind, size, automatic, outcome.

    Columns used: group_id, group_kind, rank, file_id, keeper_id, kind, confidence, size, unchanged,
    keeper_unchanged, same_file, still_identical, cross_drive.  Automatic members of a group come
    before those that were asked.  A file moved by an earlier group can neither be moved again
    (AlreadyHandled) nor be kept in its place (KeeperUnavailable).  ``space`` is (free, total) of the
    quarantine's disk: the first file from another drive that would leave too little suspends the
    run (QuarantineFull), and all after it wait.

    A position depends on earlier ones only, through files that are a member of several groups.  So
    the fold is a fixed point: all that may move by themselves are taken as moved, then those that
    an earlier move rules out are taken back, until nothing changes; the rounds are the length of
    the longest chain of groups, not their number.
    """
    scratch = Scratch(members.sparkSession, "fold")
    dups = members.where("rank > 1")
    if options.mode == "ReadOnly":
        done = dups.withColumns({"automatic": F.lit(False), "outcome": F.lit("ReportOnly")})
        return numbered(done, ["group_id", "rank", "file_id"], "position", scratch).select(*FOLD)
    none = members.sparkSession.createDataFrame([], "group_id long, choice string")
    asked = _asked(dups, none if decisions is None else decisions, options)
    order = ["group_id", F.desc("automatic"), "rank", "file_id"]
    rows = scratch.cut(numbered(asked, order, "position", scratch), "order")
    may = (F.col("choice") == "Apply") & F.col("unchanged") & F.col("keeper_unchanged") & ~F.col("same_file") & F.col("still_identical")
    moved = scratch.cut(rows.where(may).select("file_id", "keeper_id", "position"), "may")
    every, left = moved, moved.count()
    while True:
        gone = moved.groupBy("file_id").agg(F.min("position").alias("_at"))
        keeper_gone = gone.select(F.col("file_id").alias("keeper_id"), F.col("_at").alias("_keeper_at"))
        met = every.join(gone, "file_id", "left").join(keeper_gone, "keeper_id", "left")
        free = (F.col("_at").isNull() | (F.col("_at") >= F.col("position"))) & (F.col("_keeper_at").isNull() | (F.col("_keeper_at") > F.col("position")))
        before, moved = moved, scratch.cut(met.where(free).select("file_id", "keeper_id", "position"), "moved")
        was, left = left, moved.count()
        if was == left and not moved.join(before, "position", "left_anti").limit(1).count():
            break
    gone = moved.groupBy("file_id").agg(F.min("position").alias("_at"))
    keeper_gone = gone.select(F.col("file_id").alias("keeper_id"), F.col("_at").alias("_keeper_at"))
    told = rows.join(gone, "file_id", "left").join(keeper_gone, "keeper_id", "left")
    before = lambda c: F.coalesce(F.col(c) < F.col("position"), F.lit(False))
    outcome = (
        F.when(F.col("choice") == "Skip", "Skipped")
        .when(F.col("choice") != "Apply", "AwaitingReview")
        .when(before("_keeper_at") | ~F.col("keeper_unchanged"), "KeeperUnavailable")
        .when(before("_at"), "AlreadyHandled")
        .when(~F.col("unchanged"), "ChangedSinceScan")
        .when(F.col("same_file"), "SameFile")
        .when(~F.col("still_identical"), "ByteCheckFailed")
        .otherwise("Moved")
    )
    told = scratch.cut(told.withColumn("outcome", outcome).drop("_at", "_keeper_at"), "told")
    if space is None:
        return told.select(*FOLD)
    # the disk is looked at before the byte check, so a file that fails it can be the first too
    weighed = F.col("outcome").isin("Moved", "ByteCheckFailed") & F.col("cross_drive")
    used = running(told, ["position"], F.when(F.col("cross_drive") & (F.col("outcome") == "Moved"), F.col("size")).otherwise(0), "_used", scratch)
    adding = F.col("_used") + F.when(F.col("outcome") == "Moved", 0).otherwise(F.col("size"))
    full = used.where(weighed & is_low(F.lit(space[0]).cast("long"), F.lit(space[1]).cast("long"), adding)).agg(F.min("position")).first()[0]
    if full is None:
        return told.select(*FOLD)
    stopped = F.when(F.col("position") == full, "QuarantineFull").when(F.col("position") > full, "AwaitingReview").otherwise(F.col("outcome"))
    return told.withColumn("outcome", stopped).select(*FOLD)


def recheck(members: DataFrame, contents: DataFrame | InColumn | ByPath, options: Options) -> DataFrame:
    """``members`` with still_identical: whether a byte-identical duplicate and its keeper still are,
    by their present ``contents`` (a reader of them, or a table of file_id and content).  Ends are
    compared by their hash, a video's sampled blocks, or with ``verify_before_move`` everything;
    other kinds are not held against their bytes, and a file that can't be read is not identical."""
    scratch = Scratch(members.sparkSession, "recheck")
    reader = InColumn(contents, options=options) if isinstance(contents, DataFrame) else contents
    pairs = members.where((F.col("rank") > 1) & F.col("kind").isin("ExactBytes", "VideoSampled")).select("file_id", "keeper_id", "is_video")
    how = F.lit(FULL) if options.verify_before_move else F.when(F.col("is_video"), SAMPLE).otherwise(PARTIAL)
    ends = pairs.select(F.explode(F.array("file_id", "keeper_id")).alias("file_id"), how.alias("how")).distinct()
    read = scratch.cut(reader.hashes(scratch.cut(ends, "asked")).select("file_id", "how", F.concat_ws(":", "hash", F.col("size").cast("string")).alias("_h")).where("hash is not null"), "read")
    own, kept = read.toDF("file_id", "_how", "_own"), read.toDF("keeper_id", "_how", "_kept")
    checked = pairs.select("file_id", "keeper_id", how.alias("_how")).join(own, ["file_id", "_how"], "left").join(kept, ["keeper_id", "_how"], "left").select("file_id", "keeper_id", F.coalesce(F.col("_own") == F.col("_kept"), F.lit(False)).alias("_same"))
    return members.join(checked.distinct(), ["file_id", "keeper_id"], "left").withColumn("still_identical", F.coalesce("_same", F.lit(True))).drop("_same")


#: Columns of ``execute``.
FOLD = ("group_id", "position", "file_id", "keeper_id", "kind", "size", "automatic", "outcome")


def summary(plan: DataFrame) -> DataFrame:
    """Counters of one run."""
    is_ = lambda s: F.col("outcome") == s
    return plan.agg(F.count_if(is_("Planned") | is_("Moved")).alias("moved"), F.coalesce(F.sum(F.when(is_("Planned") | is_("Moved"), F.col("size"))), F.lit(0)).cast("long").alias("moved_bytes"), F.count_if(F.col("outcome").isin("AwaitingReview", "QuarantineFull")).alias("awaiting"), F.count_if(~F.col("outcome").isin("Planned", "Moved", "AwaitingReview", "QuarantineFull")).alias("blocked"))


def undo_plan(journal: DataFrame, present: DataFrame) -> DataFrame:
    """Newest first, what undoing each journal row (seq, method, original_path, moved_to) does:
    DeletedForGood, InBin, Missing, Occupied or Restore."""
    here = present.select(F.upper("path").alias("_p")).distinct()
    a, b = here.withColumnRenamed("_p", "_at"), here.withColumnRenamed("_p", "_orig")
    joined = journal.join(a, F.upper("moved_to") == F.col("_at"), "left").join(b, F.upper("original_path") == F.col("_orig"), "left")
    outcome = (
        F.when(F.col("method") == "PermanentlyDeleted", "DeletedForGood")
        .when((F.col("method") != "Quarantine") | F.col("moved_to").isNull(), "InBin")
        .when(F.col("_at").isNull(), "Missing")
        .when(F.col("_orig").isNotNull(), "Occupied")
        .otherwise("Restore")
    )
    return joined.withColumn("outcome", outcome).drop("_at", "_orig").orderBy(F.desc("seq"))


def crosses_drives(quarantine: Column, path: Column) -> Column:
    """Whether a move is a copy between two drives."""
    return drive(quarantine) != drive(path)


def has_bin(path: Column, fixed_drives: Sequence[str]) -> Column:
    """Whether deleted files of this path go to a recycle bin: on fixed drives with a letter only."""
    return F.coalesce(drive(path).isin(*[d.upper() for d in fixed_drives if not d.startswith("\\\\") and d != "/"]), F.lit(False))


def destinations(moves: DataFrame, session_root: str, order: str = "position") -> DataFrame:
    """``moves`` (path) with moved_to: the place in the quarantine; further files of one place, in
    any case, get " ~2", " ~3" ... before the extension."""
    place = quarantine_path(session_root, F.col("path"))
    nth = F.row_number().over(W.partitionBy(F.upper(place)).orderBy(order, "path"))
    split = r"^(.*?)(\.[^./\\]*)?$"
    again = F.concat(F.regexp_extract(place, split, 1), F.lit(" ~"), F.col("_nth").cast("string"), F.regexp_extract(place, split, 2))
    return moves.withColumn("_nth", nth).withColumn("moved_to", F.when(F.col("_nth") == 1, place).otherwise(again)).drop("_nth")


def review_rows(members: DataFrame, options: Options) -> DataFrame:
    """One review row per duplicate; in read-only mode they are only reported."""
    status = "ReportOnly" if options.mode == "ReadOnly" else "Pending"
    return members.where("rank > 1").withColumn("status", F.lit(status))


def review_filter(review: DataFrame, which: str) -> DataFrame:
    """Rows of a filter: All, Pending, Moved, Skipped, or a kind by its short name."""
    kinds = {"Exact": "ExactBytes", "Pixels": "IdenticalPixels", "Perceptual": "Perceptual", "Burst": "Burst", "Videos": "VideoSampled"}
    if which == "All":
        return review
    return review.where(F.col("kind") == kinds[which]) if which in kinds else review.where(F.col("status").isin(*(("Moved", "Deleted") if which == "Moved" else (which,))))


def review_counters(review: DataFrame) -> DataFrame:
    """Pending, moved, skipped, moved bytes and bytes still reclaimable, in one pass."""
    is_ = lambda *s: F.col("status").isin(*s)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    return review.agg(F.count_if(is_("Pending")).alias("pending"), F.count_if(is_("Moved", "Deleted")).alias("moved"), F.count_if(is_("Skipped")).alias("skipped"), total(is_("Moved", "Deleted")).alias("moved_bytes"), total(is_("Pending", "ReportOnly")).alias("reclaimable_bytes"))


def switch_mode(review: DataFrame, read_only: bool) -> DataFrame:
    """Mode switch after a search: pending and report-only rows swap, decided rows stay."""
    old, new = ("Pending", "ReportOnly") if read_only else ("ReportOnly", "Pending")
    return review.withColumn("status", F.when(F.col("status") == old, new).otherwise(F.col("status")))


def rebuild_review(old: DataFrame, new: DataFrame) -> DataFrame:
    """Review rows after a group changed: new members keep a moved status only, and moved rows
    that left the group stay."""
    a = old.select("file_id", F.col("status").alias("_s"), F.struct(*old.columns).alias("_o"))
    b = new.select("file_id", F.struct(*new.columns).alias("_n"))
    done = F.col("_s").isin("Moved", "Deleted")
    joined = b.join(a, "file_id", "full").where(F.col("_n").isNotNull() | done)
    return joined.select("file_id", F.coalesce(F.when(done, F.col("_s")), F.col("_n.status")).alias("status"), *[F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")).alias(c) for c in new.columns if c not in ("file_id", "status")])


def same_kind_count(review: DataFrame, kind: str) -> DataFrame:
    """Pending rows of a kind that a "yes to all of this kind" would cover."""
    return review.agg(F.count_if((F.col("status") == "Pending") & (F.col("kind") == kind) & (F.col("confidence") >= K.SAME_KIND_FLOOR)).alias("same_kind"))


def review_cursor(review: DataFrame, order: Sequence[str | Column], read_only: bool = False) -> DataFrame:
    """``review`` with its place in the list and where a review goes from each row: position, and the
    positions after_decision (the next pending row, else the first before it, else null), forward and
    back (the pending row to either side, round the ends of the list; with none pending, or in
    read-only mode, the row beside)."""
    rows = beside(review, order, F.col("status") == "Pending")
    sized = rows.withColumn("_count", F.lit(review.count()))
    near = F.lit(read_only) | F.col("_first").isNull()
    ahead = F.when(near, F.col("position") % F.col("_count") + 1).otherwise(F.coalesce("_next", "_first"))
    behind = F.when(near, (F.col("position") + F.col("_count") - 2) % F.col("_count") + 1).otherwise(F.coalesce("_last", "_final"))
    decided = F.coalesce("_next", F.when(F.col("_first") < F.col("position"), F.col("_first")))
    return sized.withColumns({"after_decision": decided, "forward": ahead, "back": behind}).drop("_next", "_last", "_first", "_final", "_count")


def keep_both(review: DataFrame, chosen: DataFrame) -> DataFrame:
    """``review`` with the pending rows of ``chosen`` (group_id, file_id) skipped."""
    mine = chosen.select("group_id", "file_id").distinct().withColumn("_chosen", F.lit(True))
    done = F.coalesce("_chosen", F.lit(False)) & (F.col("status") == "Pending")
    return review.join(mine, ["group_id", "file_id"], "left").withColumn("status", F.when(done, "Skipped").otherwise(F.col("status"))).select(review.columns)


def all_of_kind(review: DataFrame, kind: str) -> DataFrame:
    """``review`` with the rows that a "yes to all of this kind" covers as chosen to be moved (column
    chosen): pending ones that are sure enough; the others are decided one by one."""
    return review.withColumn("chosen", F.coalesce((F.col("status") == "Pending") & (F.col("kind") == kind) & (F.col("confidence") >= K.SAME_KIND_FLOOR), F.lit(False)))


def swap(review: DataFrame, members: DataFrame, choices: DataFrame, options: Options) -> DataFrame:
    """``review`` after the files of ``choices`` (group_key, file_id) have become the keepers of their
    groups: the groups' rows are made again from ``members``, and only moved rows keep their status.
    Columns of ``review`` are those of its members and status."""
    changed = change_keeper(members, choices, options)
    keys = choices.select("group_key").distinct()
    fresh = review_rows(changed, options)
    columns = [c for c in review.columns if c in fresh.columns]
    old = review.select(columns)
    again = rebuild_review(old.join(keys, "group_key", "left_semi"), fresh.select(columns))
    return old.join(keys, "group_key", "left_anti").unionByName(again.select(columns))
