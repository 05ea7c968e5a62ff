"""Candidate generation: exact sets, bands of hashes, temporal pairs and their union."""

from __future__ import annotations

import math
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import micros
from ..options import Options
from ..runtime import Scratch
from .contents import FULL, PARTIAL, SAMPLE, ByPath, InColumn
from .ranking import numbered


def with_peers(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs twice or more; the count is combined on the map side."""
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return rows.join(shared, list(keys), "left_semi")


def exact_levels(files: DataFrame, content: str = "content", options: Options | None = None, scratch: Scratch | None = None, reader: InColumn | ByPath | None = None) -> tuple[DataFrame, DataFrame]:
    """Files in sets of equal content, with partial_hash, full_hash, sample_hash and set_key, and
    (file_id, error) of the files that could not be read.

    Cheapest test first: only files that share size and kind are hashed in part, only those that
    still share are hashed whole (or by sampled blocks, for videos on a quick check); a hash that
    is known already is taken.  The levels shuffle ids, sizes and hashes; contents are read by
    ``reader`` (by default from the column ``content``) where they lie, and are not in the result.
    """
    o = options or Options()
    scratch = scratch or Scratch(files.sparkSession, "exact")
    reader = reader or InColumn(files, content, o)
    by = ["size", "is_video"]
    known = lambda c: F.col(c).alias(f"_{c}") if c in files.columns else F.lit(None).cast("string").alias(f"_{c}")
    slim = files.where("size > 0").select("file_id", *by, *[known(c) for c in ("partial_hash", "full_hash", "sample_hash")])
    slim = scratch.cut(with_peers(slim, *by), "sized")

    def hashed(rows: DataFrame, how: Column, taken: Column, name: str) -> DataFrame:
        """``rows`` with hash and error: the hash that is known, else one that is read."""
        asked = rows.select("file_id", how.alias("how"), taken.alias("_taken"))
        missing = scratch.cut(asked.where("_taken is null").select("file_id", "how"), f"{name}-asked")
        read = scratch.cut(reader.hashes(missing).select("file_id", "hash", "error"), name)
        return rows.join(read, "file_id", "left").withColumn("hash", F.coalesce(taken, "hash"))

    first = hashed(slim, F.lit(PARTIAL), F.col("_partial_hash"), "partial")
    near = scratch.cut(with_peers(first.where("hash is not null").drop("error"), *by, "hash").withColumnRenamed("hash", "_partial"), "near")
    quick = F.col("is_video") & F.lit(o.quick_video_check)
    second = hashed(near, F.when(quick, SAMPLE).otherwise(FULL), F.when(quick, F.col("_sample_hash")).otherwise(F.col("_full_hash")), "full")
    key = F.concat_ws(":", "hash", F.col("size").cast("string"), F.col("is_video").cast("string"))
    keyed = second.where("hash is not null").select("file_id", F.col("_partial").alias("partial_hash"), F.when(~quick, F.col("hash")).alias("full_hash"), F.when(quick, F.col("hash")).alias("sample_hash"), key.alias("set_key"))
    found = scratch.cut(with_peers(keyed, "set_key"), "sets")
    errors = first.unionByName(second, allowMissingColumns=True).where("error is not null").select("file_id", "error")
    return files.select(*[c for c in files.columns if c == "file_id" or c not in (*found.columns, content)]).join(found, "file_id"), errors


def exact_sets(files: DataFrame, content: str = "content", options: Options | None = None, scratch: Scratch | None = None, reader: InColumn | ByPath | None = None) -> DataFrame:
    """The sets of ``exact_levels``."""
    return exact_levels(files, content, options, scratch, reader)[0]


def remove_aliases(members: DataFrame, set_key: str = "set_key", device: str = "device", inode: str = "inode", order: str = "file_id") -> DataFrame:
    """Rows of a set that are one file under several names collapse to the first; an unknown
    identity (null or zero) is never equal to another."""
    known = F.col(device).isNotNull() & F.col(inode).isNotNull() & (F.col(inode) != 0)
    identity = F.when(known, F.concat_ws(":", F.col(device).cast("string"), F.col(inode).cast("string"))).otherwise(F.concat(F.lit("row:"), F.col(order).cast("string")))
    return members.withColumn("_same", identity).withColumn("_nth", F.row_number().over(W.partitionBy(set_key, "_same").orderBy(order))).where("_nth = 1").drop("_same", "_nth")


#: Most probes of a band.
PROBES = 5_000


def bands(distance: int, count: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks) of bands such that two hashes within ``distance`` agree in one of them
    after one of its masks.

    With m bands some band differs in at most distance / m bits, so the masks are all changes of so
    many bits.  Few wide bands ask for more masks but meet fewer strangers; the number with the
    least work for ``count`` hashes is taken, so a bucket's rows stay few as hashes get many.
    """
    best = None
    for m in range(1, distance + 2):
        edges = [round(64 * k / m) for k in range(m + 1)]
        widths, most = [hi - lo for lo, hi in pairwise(edges)], distance // m
        probes = sum(sum(math.comb(w, k) for k in range(most + 1)) for w in widths)
        if probes > PROBES * m:
            continue
        work = sum(sum(math.comb(w, k) for k in range(most + 1)) * (1 + count / 2.0**w) for w in widths) + m
        if best is None or work < best[0]:
            best = (work, edges, most)
    _, edges, most = best
    masks = lambda w: [sum(1 << i for i in bits) for k in range(most + 1) for bits in combinations(range(w), k)]
    return [(lo, hi - lo, masks(hi - lo)) for lo, hi in pairwise(edges)]


#: Work of a shuffled row and of a comparison of two hashes inside a task, in one unit.
ROW_WORK, PAIR_WORK = 1000.0, 2.0
#: Most bits of a band's value; a band leaves the rest of a wider one out, which the rule allows.
WIDEST = 48


def band_plan(distance: int, rows: int, probes: int) -> list[tuple[int, int, list[int], int]]:
    """(shift, width, masks, most) of bands for a join inside tasks: two hashes within ``distance`` differ
    in at most ``most`` bits in one of them, so agree there after one of its masks.

    The bands need not allow alike: as soon as the sum of ``most + 1`` is above ``distance``, one
    of them holds.  Of all such plans that with the least work is taken: rows are shuffled once a mask
    and probes once a band, and what shares a value is compared.
    """
    best = None
    for twos in range((distance + 1) // 3 + 1):
        for ones in range((distance + 1 - 3 * twos) // 2 + 1):
            allowed = [2] * twos + [1] * ones + [0] * (distance + 1 - 3 * twos - 2 * ones)
            for extra in range(9):
                base = (64 - extra * sum(allowed)) / len(allowed)
                edges = [round(sum(base + extra * t for t in allowed[:k])) for k in range(len(allowed) + 1)]
                widths = [min(hi - lo, WIDEST) for lo, hi in pairwise(edges)]
                if min(widths) < 1:
                    continue
                counts = [sum(math.comb(w, k) for k in range(t + 1)) for w, t in zip(widths, allowed, strict=True)]
                work = ROW_WORK * (rows * sum(counts) + probes * len(widths)) + PAIR_WORK * rows * probes * sum(c / 2.0**w for c, w in zip(counts, widths, strict=True))
                if best is None or work < best[0]:
                    best = (work, edges, allowed)
    _, edges, allowed = best
    masks = lambda w, t: [sum(1 << i for i in bits) for k in range(t + 1) for bits in combinations(range(w), k)]
    return [(lo, w, masks(w, t), t) for lo, w, t in zip(edges, (min(hi - lo, WIDEST) for lo, hi in pairwise(edges)), allowed, strict=False)]


def burst_pairs(files: DataFrame, window_seconds: float, id_col: str = "file_id", time_col: str = "taken_at", camera_col: str = "camera_key") -> DataFrame:
    """(a, b, delta_us) with a < b of one camera at most ``window_seconds`` apart.

    An interval join by buckets as wide as the window: a row looks into its own bucket and the
    next, so the key is (camera, bucket) and a busy camera is spread over its buckets.
    """
    width = int(window_seconds * 1_000_000)
    own = files.where(F.col(time_col).isNotNull()).select(F.col(id_col).alias("id"), micros(F.col(time_col)).alias("us"), F.coalesce(F.col(camera_col).cast("string"), F.lit("")).alias("camera"))
    own = own.withColumn("bucket", F.floor(F.col("us") / width).cast("long"))
    later = own.select(F.col("id").alias("id2"), F.col("us").alias("us2"), "camera", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"))
    met = own.join(later, ["camera", "bucket"]).withColumn("delta_us", F.col("us2") - F.col("us"))
    kept = met.where((F.col("id") != F.col("id2")) & ((F.col("delta_us") > 0) | ((F.col("delta_us") == 0) & (F.col("id") < F.col("id2")))) & (F.col("delta_us") <= width))
    return kept.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "delta_us")


def burst_pairs_capped(files: DataFrame, window_seconds: float, neighbours: int = 60, id_col: str = "file_id", time_col: str = "taken_at", camera_col: str = "camera_key", scratch: Scratch | None = None) -> DataFrame:
    """As ``burst_pairs``, but only among the next ``neighbours`` captures of any camera in time.

    Captures are numbered in global time order.  A row looks into its own block of ``neighbours``
    numbers and the next, so it meets twice that many rows at most, however many share a time.
    """
    width = int(window_seconds * 1_000_000)
    own = files.where(F.col(time_col).isNotNull()).select(F.col(id_col).alias("id"), micros(F.col(time_col)).alias("us"), F.coalesce(F.col(camera_col).cast("string"), F.lit("")).alias("camera"))
    scratch = scratch or Scratch(files.sparkSession, "bursts")
    placed = scratch.cut(numbered(own, ["us", "id"], "n", scratch), "numbered").withColumn("block", F.floor(F.col("n") / neighbours).cast("long"))
    later = placed.select(F.col("id").alias("id2"), F.col("us").alias("us2"), "camera", F.col("n").alias("n2"), F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    met = placed.join(later, ["camera", "block"]).where((F.col("n2") > F.col("n")) & (F.col("n2") - F.col("n") <= neighbours) & (F.col("us2") - F.col("us") <= width))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), (F.col("us2") - F.col("us")).alias("delta_us"))


def union_pairs(*parts: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b), a < b, of several candidate lists."""
    out = None
    for part in parts:
        one = part.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()
