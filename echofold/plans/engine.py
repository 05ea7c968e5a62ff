"""The whole funnel: inventory to numbered groups, each level lazily built on the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import blocking, groups, similarity
from ..operators import cache as cached
from ..operators.contents import ByPath, InColumn
from ..options import Options
from ..runtime import Scratch

#: Columns of a file that scoring and keeper choice read, with the value where a level has not run.
FILE_COLUMNS = {
    "file_id": "long", "path": "string", "size": "long", "root": "string", "is_video": "boolean", "normalized": "string", "has_copy": "boolean", "has_edit": "boolean",
    "last_write": "timestamp_ntz", "full_hash": "string", "sample_hash": "string", "pixel_hash": "string", "width": "int", "height": "int", "phash": "array<bigint>", "dhash": "bigint",
    "sharpness": "double", "embedding": "array<double>", "taken_at": "timestamp_ntz", "camera_key": "string", "latitude": "double", "longitude": "double", "richness": "int", "error": "string",
    "device": "long", "inode": "long", "mtime_ticks": "long",
}


#: What the cache keeps of a file, valid for its path, size and time.  Values that depend on options
#: or on the network too (sampled hashes, vectors) are not kept.
CACHED = ("full_hash", "pixel_hash", "width", "height", "phash", "dhash", "sharpness", "taken_at", "camera_key", "latitude", "longitude", "richness")


@dataclass
class Result:
    """``files`` after analysis, ``members`` of all groups, one row per group, and the cache to
    store for the next run."""

    files: DataFrame
    members: DataFrame
    groups: DataFrame
    cache: DataFrame


def complete(files: DataFrame) -> DataFrame:
    """All file columns, null where missing."""
    return files.select(*[(F.col(c).cast(t) if c in files.columns else F.lit(None).cast(t)).alias(c) for c, t in FILE_COLUMNS.items()])


def filled(files: DataFrame, found: DataFrame) -> DataFrame:
    """``files`` with the columns of ``found`` (by file_id) where they have none of their own."""
    new = [c for c in found.columns if c != "file_id"]
    joined = files.join(found.select("file_id", *[F.col(c).alias(f"_{c}") for c in new]), "file_id", "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in new}).select(files.columns)


def pixel_candidates(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of files without a pixel hash in a pair that agrees in its upright hashes and sides:
    only these are worth a full decode."""
    own = files.select("file_id", "phash", "width", "height", "pixel_hash")
    a, b = (own.select(*[F.col(c).alias(f"{c}_{side}") for c in own.columns]) for side in "ab")
    both = pairs.select("a", "b").join(a, F.col("a") == F.col("file_id_a")).join(b, F.col("b") == F.col("file_id_b"))
    upright = hashing.best_orientation(F.get("phash_a", F.lit(0)), F.col("phash_b"))
    alike = both.where((upright["distance"] == 0) & (upright["variant"] == 0) & (F.col("width_a") == F.col("width_b")) & (F.col("height_a") == F.col("height_b")))
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("pixel_hash_a").alias("p")), F.struct(F.col("b").alias("id"), F.col("pixel_hash_b").alias("p")))
    return alike.select(F.explode(ends).alias("e")).where("e.p is null").select(F.col("e.id").alias("file_id")).distinct()


def crowded_twins(crowded: DataFrame, files: DataFrame) -> DataFrame:
    """Ids without a pixel hash in large classes of equal hashes, whose sides occur twice there: such
    pictures may be the same whenever they were taken, and not all their pairs are candidates."""
    own = crowded.join(files.select("file_id", "width", "height", "pixel_hash"), "file_id")
    shared = own.groupBy("group", "width", "height").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return own.where("pixel_hash is null").join(shared, ["group", "width", "height"], "left_semi").select("file_id").distinct()


def run(files: DataFrame, analyse=None, options: Options | None = None, pixels=None, embed=None, cache: DataFrame | None = None, reader: InColumn | ByPath | None = None) -> Result:
    """Finds, scores and groups duplicates of ``files`` (file columns).  Contents come from ``reader``,
    by default from a column ``content`` of ``files``; no level shuffles them.

    Three functions map files with content to columns by file_id, each for the files that need it:
    ``analyse`` for the visual columns of representatives (photos without error that are no hidden
    exact duplicate) that have none; ``pixels`` for the pixel hashes of ``pixel_candidates``; ``embed``
    for the vectors of files in a candidate pair (without it there are none).  ``cache`` is the
    result's cache of an earlier run: files unchanged since are not analysed again.  Exact
    duplicates take over their keeper's columns.  Further names of one file (device, inode) in an
    exact set leave the inventory.
    """
    o = options or Options()
    scratch = Scratch(files.sparkSession, "engine")
    reader = reader or InColumn(files, options=o)
    base = complete(files)
    base = base.withColumn("mtime_ticks", F.coalesce("mtime_ticks", F.unix_micros(F.col("last_write").cast("timestamp")) * 10))
    if cache is not None:
        hits = cached.apply(base.select("file_id", "path", "size", "mtime_ticks"), cache, list(CACHED)).where("cache_hit").select("file_id", *CACHED)
        base = scratch.cut(filled(base, hits), "base")

    # level 1: equal contents, without further names of one file
    base = scratch.cut(base, "files") if cache is None else base
    found, failed = blocking.exact_levels(base, options=o, scratch=scratch, reader=reader)
    found, failed = scratch.cut(found.select(*FILE_COLUMNS, "set_key"), "named"), scratch.cut(failed.groupBy("file_id").agg(F.min("error").alias("error")), "failed")
    sets = scratch.cut(blocking.remove_aliases(found), "sets")
    aliases = found.select("file_id").join(sets.select("file_id"), "file_id", "left_anti")
    exact = scratch.cut(groups.exact_groups(blocking.with_peers(sets, "set_key"), o), "exact")
    known = filled(filled(base.join(aliases, "file_id", "left_anti"), found.select("file_id", "full_hash", "sample_hash")), failed)

    # visual analysis of representatives
    hidden = exact.where("rank > 1").select("file_id")
    unread = known.where("error is not null")
    seen = scratch.cut(known.where(~F.col("is_video") & F.col("error").isNull()).join(hidden, "file_id", "left_anti"), "representatives")
    if analyse is not None:
        seen = filled(seen, analyse(reader.of(seen.where("phash is null").select("file_id"))))
    seen = scratch.cut(complete(seen), "analysed")
    bad = scratch.cut(seen.where("error is not null").unionByName(unread.select(seen.columns)), "bad")
    first = (base, found, failed, sets, bad)
    scratch.keep_only(*first, exact, seen)
    seen = seen.where("error is null")

    # candidates, and what only they need
    near, crowded = similarity.candidates(seen, o.perceptual_max_distance, o, scratch)
    parts = [near] + ([blocking.burst_pairs_capped(seen, o.burst_window_seconds, o.burst_neighbours, scratch=scratch)] if o.detect_bursts else [])
    pairs = scratch.cut(blocking.union_pairs(*parts), "pairs")
    if pixels is not None:
        asked = pixel_candidates(pairs, seen).unionByName(crowded_twins(crowded, seen)).distinct()
        seen = scratch.cut(filled(seen, pixels(reader.of(asked))), "pixels")
        alike = seen.where("pixel_hash is not null").join(crowded.select("file_id").distinct(), "file_id", "left_semi")
        timeless = similarity.captures(alike.withColumn("taken_at", F.lit(None).cast("timestamp_ntz")), F.col("pixel_hash"))
        pairs = scratch.cut(blocking.union_pairs(pairs, similarity.capture_links(timeless, scratch=scratch)), "pairs")
    if embed is not None:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("file_id")).distinct()
        missing = ends.join(seen.where("embedding is null").select("file_id"), "file_id")
        seen = filled(seen, embed(reader.of(missing)))
    seen = scratch.cut(seen, "seen")

    # scores, groups, numbers
    edges = scratch.cut(groups.score_pairs(pairs, seen, o), "scored")
    scratch.keep_only(*first, exact, seen, edges)  # hashes, classes and pairs are read no more
    alike = groups.similarity_groups(edges, seen, o, scratch)
    wide = ["group_key", "rank", "keeper_id", "keeper_reason", "kind", "confidence", "reason", *FILE_COLUMNS]
    members = groups.inherit(exact, seen).withColumn("group_key", F.concat(F.lit("x"), F.col("group_key")))
    members = complete(members).join(members.select("file_id", "group_key", "rank", "keeper_id", "keeper_reason", "kind", "confidence", "reason"), "file_id").select(wide)
    members = members.unionByName(alike.withColumn("group_key", F.concat(F.lit("s"), F.col("group_key").cast("string"))).select(wide))
    if o.cross_folder_only:
        members = groups.set_aside(members)
    members = scratch.cut(members, "members")
    ranked = scratch.cut(groups.number(groups.summarise(members), scratch), "groups")
    scratch.keep_only(*first, seen, members, ranked)

    # every file that was hashed or analysed is worth keeping for the next run
    rest = known.join(seen.select("file_id").unionByName(bad.select("file_id")), "file_id", "left_anti")
    kept = seen.unionByName(rest.select(seen.columns)).where("full_hash is not null or phash is not null")
    fresh = kept.select("path", "size", "mtime_ticks", *CACHED)
    if cache is not None:
        fresh = cached.prune(cached.store(cache.select(fresh.columns), fresh), base.select("root"), base)
    return Result(seen.unionByName(bad), members.join(ranked.select("group_key", "group_id", F.col("kind").alias("group_kind")), "group_key"), ranked, fresh)
