"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives each document's set of five-word shingles as a 128-bit digest,
   its size, ``PERMUTATIONS`` minima, of which the low ``BITS`` bits are kept as a packed
   signature, and ``BANDS`` band keys of ``ROWS`` whole minima each.
2. Documents of one digest are one class; only classes take part from here on, so exact copies
   cost one row however many they are.
3. Classes that share a band key are candidates.  In rounds, each bucket takes a centre (another
   one each round), every component of classes pairs its members with the centres of their buckets,
   and keeps the pair with the highest collision-corrected similarity, from counted equal low
   bits.  These pairs are confirmed on full sets and merge components; each round is linear in the
   rows of buckets that still hold two components, and rounds end when none links.
4. Classes of buckets that still hold two components are set aside where so many of their shingles
   occur in no other such class that no similarity can reach the threshold (exact, and linear in
   the shingles).  Of the buckets left, those of at most ``SMALL`` rows give all pairs across
   components whose estimate is at least the threshold less ``SLACK``, which are confirmed.  In
   larger ones all rows outside the bucket's main component are compared with all its rows, in
   blocks and inside the tasks: first by estimate, then on full sets; only links leave a task.
   No bucket, partner or candidate is capped or dropped.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6, and its estimate
falls more than SLACK short with probability 5e-5; both fall fast above 0.75.

Texts are read a second time for the classes in a candidate pair only: by a broadcast of their
text hashes while those are few (``BROADCAST_TEXTS``, counted first), by a shuffled join beyond.
All pairs, components and fingerprints stay in tables.

Defined results: null or wordless text has an empty set (digest null), links with nothing and is
its own component; rows of one digest (repeated rows too) are linked; null ids link like others,
and a component's id is its smallest non-null id; other columns are ignored by ``link`` and pass
through ``deduplicate``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import components
from ..runtime import Scratch
from . import textvec
from .columns import unused

WIDTH = 5
NUMERATOR, DENOMINATOR = 3, 4  # linked at similarity 3/4 or more
PERMUTATIONS, BITS = 256, 4
BANDS, ROWS = 32, 4
SLACK = 0.11
#: Most rows of a bucket whose pairs are rows of a join, and rows of a block in larger buckets.
SMALL, BLOCK = 48, 256
#: Most rounds with centres, and most times that lone classes are set aside, before all remaining
#: pairs are tried.
ROUNDS = 3
PEELS = 2
#: Most text hashes that are broadcast to fetch candidate texts (8 bytes each).
BROADCAST_TEXTS = 1_000_000

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_LONGS = PERMUTATIONS * BITS // 64


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row on end, and where each row's begin."""
    hashes, first = textvec.words(data, offsets)
    h, row = textvec.shingles(hashes, first, width)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    parts = [np.unique(h[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def _minima(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least value of every permutation over each non-empty set (permutations x sets)."""
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    out, room = np.empty((PERMUTATIONS, len(starts)), np.uint32), np.empty(len(x), np.uint32)
    for j in range(PERMUTATIONS):
        np.multiply(x, _A[j], out=room)
        np.add(room, _B[j], out=room)
        out[j] = np.minimum.reduceat(room, starts)
    return out


def _signature(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed (sets x longs)."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(_LONGS, 64 // BITS, -1)
    shift = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.bitwise_or.reduce(low << shift, axis=1).T.astype(np.int64)


def _bands(minima: np.ndarray) -> np.ndarray:
    """Band keys (sets x bands), each a hash of its number and its minima."""
    own = minima[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS, -1)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15), own[:, 0].shape).copy()
    for r in range(ROWS):
        key = textvec.mix(key ^ (own[:, r] + textvec.PLACE[r]))
    return key.T.astype(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _describe(width: int) -> Callable:
    """Per row: its key columns, set size, digest, signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.buffer_of(batch.column(batch.num_columns - 1))
            for lo, hi in textvec.chunks(offsets):
                sets, at = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                size = np.diff(at)
                has = np.flatnonzero(size)
                digests: list[bytes | None] = [_digest(sets[at[r] : at[r + 1]]) if size[r] else None for r in range(hi - lo)]
                sig, bands = np.zeros((hi - lo, _LONGS), np.int64), np.zeros((hi - lo, BANDS), np.int64)
                if len(has):
                    minima = _minima(sets, at[has])
                    sig[has], bands[has] = _signature(minima), _bands(minima)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                keys = [batch.column(k).slice(lo, hi - lo) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(size), pa.array(digests, pa.binary()), lists(sig), lists(bands)], [*batch.schema.names[:-1], "n_shingles", "digest", "sig", "bands"])

    return run


def _full_sets(width: int) -> Callable:
    """Per row: digest and the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.buffer_of(batch.column(0))
            for lo, hi in textvec.chunks(offsets):
                sets, at = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                digests = [_digest(sets[at[r] : at[r + 1]]) for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.astype(np.int64)))], ["digest", "shingles"])

    return run


def _estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def equal(k: int) -> Column:
        x = F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))
        folded = reduce(lambda p, q: p.bitwiseOR(q), [x, *[F.shiftrightunsigned(x, s) for s in range(1, BITS)]])
        return F.lit(64 // BITS) - F.bit_count(folded.bitwiseAND(F.lit(ones)))

    agree = reduce(lambda p, q: p + q, [equal(k) for k in range(_LONGS)]) / F.lit(float(PERMUTATIONS))
    by_chance = 1.0 / (1 << BITS)
    return (agree - by_chance) / (1 - by_chance)


def _sized(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(DENOMINATOR * common >= NUMERATOR * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _open(joined: DataFrame) -> DataFrame:
    """Rows (key, node, root) of the buckets that hold two components or more."""
    keys = joined.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return joined.join(keys, "key", "left_semi").select("key", "node", "root")


def _best_with_centres(rows: DataFrame, turn: int) -> DataFrame:
    """Per component its best pair (a, b) with a centre of another component in one of its
    buckets.  The centre is the node least under a mask that differs by bucket and round."""
    mask = F.xxhash64("key", F.lit(turn)).bitwiseAND(F.lit((1 << 62) - 1))
    centres = rows.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("_low")).select("key", F.col("_low").bitwiseXOR(mask).alias("node"))
    centres = centres.join(rows, ["key", "node"]).select("key", F.col("node").alias("node2"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
    met = rows.join(centres, "key").where((F.col("root") != F.col("root2")) & _sized("n", "n2")).select("root", "node", "node2", _estimate("sig", "sig2").alias("est"))
    near = met.where(F.col("est") >= NUMERATOR / DENOMINATOR - SLACK)
    best = near.groupBy("root").agg(F.max(F.struct("est", "node", "node2")).alias("top"))
    return best.select(F.least("top.node", "top.node2").alias("a"), F.greatest("top.node", "top.node2").alias("b")).distinct()


def _apart(rows: DataFrame, traits: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes that can't link with any other of ``rows``: with u shingles that none of those has,
    a set of n shares n - u at most, which has to be the threshold's part of n at least."""
    own = rows.select("node").distinct()
    held = sets.join(own, "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    once = held.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    lone = once.groupBy("node").agg(F.count(F.lit(1)).alias("u")).join(traits.select("node", "n"), "node")
    return lone.where((F.col("n") - F.col("u")) * DENOMINATOR < F.col("n") * NUMERATOR).select("node")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) across components in buckets of at most ``SMALL`` rows that may be similar
    enough: at most ``SMALL`` for a row."""
    far = rows.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "n", "sig")])
    near = _estimate("sig", "sig2") >= NUMERATOR / DENOMINATOR - SLACK
    met = rows.join(far, (rows["key"] == far["key"]) & (F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & _sized("n", "n2") & near)
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, roots, signatures, set ends and sets on end of a block."""
    lists = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    sig, sets = lists("sig"), lists("shingles")
    ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    return t["node"].to_numpy(), t["root"].to_numpy(), sig.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, _LONGS), ends, sets.flatten().to_numpy(zero_copy_only=False)


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Confirmed links (a, b) between the rows of two blocks, one for each row of the left and
    component of the right."""
    out_a, out_b = [], []
    if left.num_rows and right.num_rows:
        node, root, sig, ends, sets = _rows_of(left)
        node2, root2, sig2, ends2, sets2 = _rows_of(right)
        size2, ones, chance = np.diff(ends2), np.uint64(sum(1 << (BITS * k) for k in range(64 // BITS))), 1 / (1 << BITS)
        for i in range(len(node)):
            x = sig[i] ^ sig2
            for s in (1, 2):
                x |= x >> np.uint64(s)
            agree = 1 - np.bitwise_count(x & ones).sum(1) / PERMUTATIONS
            may = ((agree - chance) / (1 - chance) >= NUMERATOR / DENOMINATOR - SLACK) & (root2 != root[i])
            if not may.any():
                continue
            own, where = sets[ends[i] : ends[i + 1]], np.flatnonzero(may)
            own = np.sort(own)
            picked = np.concatenate([sets2[ends2[j] : ends2[j + 1]] for j in where])
            hit = own[np.minimum(np.searchsorted(own, picked), len(own) - 1)] == picked
            common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size2[where])[:-1])))
            good = where[DENOMINATOR * common >= NUMERATOR * (len(own) + size2[where] - common)]
            _, one = np.unique(root2[good], return_index=True)
            out_a += [int(node[i])] * len(one)
            out_b += node2[good[one]].tolist()
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _large(rows: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links across components in the buckets of ``sizes`` (key, members, main): every row outside
    the bucket's main component against all rows of the bucket, in blocks of about ``BLOCK`` rows
    on either side, compared inside the tasks.  Only confirmed links leave a task."""
    full = rows.join(sizes, "key").join(sets, "node").select("key", "node", "root", "sig", "shingles", "members", "main", "outside")
    spread = lambda c, n: F.pmod(F.xxhash64("node", F.lit(c)), n).cast("int")
    many = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    columns = ["key", "i", "j", "node", "root", "sig", "shingles"]
    left = full.where("root <> main").withColumn("i", spread(1, many("outside"))).withColumn("j", every(many("members"))).select(columns).toDF(*columns)
    right = full.withColumn("j", spread(2, many("members"))).withColumn("i", every(many("outside"))).select(*[F.col(c).alias(f"{c}_") for c in columns]).toDF(*columns)
    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(_compare, "a long, b long").distinct()


def _merge(place: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) after the linked pairs (a, b) have joined their components."""
    ra, rb = place.select(F.col("node").alias("a"), F.col("root").alias("ra")), place.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    moved = components(linked.join(ra, "a").join(rb, "b").select("ra", "rb"), "ra", "rb", scratch)
    out = scratch.cut(place.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "place")
    scratch.drop(place, linked)
    return out


def _text_key(text_col: str) -> Column:
    """A 64-bit hash and the length of a text in one key."""
    return F.xxhash64(F.col(text_col), F.length(text_col))


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per row of ``docs``: _id, _text_key, n_shingles, component_id and kept."""
    scratch = Scratch(docs.sparkSession, "near")
    text_key = _text_key(text_col)
    slim = docs.select(F.col(id_col).alias("_id"), text_key.alias("_text_key"), F.col(text_col).alias("_text"))
    id_type = slim.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, _text_key long, n_shingles long, digest binary, sig array<long>, bands array<long>"
    described = scratch.cut(slim.mapInArrow(_describe(width), schema), "described")

    # one row per distinct set; the numbers of the written rows are the nodes
    one = described.where("digest is not null").groupBy("digest").agg(F.min("_id").alias("least_id"), F.min("_text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.cut(one.withColumn("node", F.monotonically_increasing_id()), "classes")

    # buckets with two classes or more
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    buckets = scratch.cut(keyed.join(shared, "key", "left_semi"), "buckets")
    traits = classes.select("node", "n", "sig")
    place = scratch.cut(buckets.select("node").distinct().withColumn("root", F.col("node")), "place")

    # full sets of the classes that share a bucket with another
    wanted = scratch.cut(classes.join(place.select("node"), "node", "left_semi").select("node", "digest", F.col("text_key").alias("_text_key")), "wanted")
    keys = wanted.select("_text_key").distinct()
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_TEXTS else keys
    texts = docs.select(text_key.alias("_text_key"), F.col(text_col).alias("_text")).join(keys, "_text_key", "left_semi")
    found = texts.select("_text").mapInArrow(_full_sets(width), "digest binary, shingles array<long>")
    found = found.groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = scratch.cut(wanted.join(found, "digest").select("node", "shingles"), "sets")

    # rounds: every component tries its best pair with a bucket's centre, until none links
    joined, past = buckets.join(place, "node"), buckets
    for turn in range(ROUNDS):
        rows = scratch.cut(_open(joined).join(traits, "node"), f"open{turn}")
        scratch.drop(past)
        joined = past = rows
        best = _best_with_centres(rows, turn)
        linked = scratch.cut(_confirm(best, sets), f"linked{turn}")
        if not linked.limit(1).count():
            break
        place = _merge(place, linked, scratch)
        joined = rows.select("key", "node").join(place, "node")

    # what is left, without classes that their own shingles keep apart from all others
    left = scratch.cut(_open(joined), "left")
    for _ in range(PEELS):
        alone = scratch.cut(_apart(left, traits, sets), "alone")
        if not alone.limit(1).count():
            break
        left = scratch.cut(_open(left.join(alone, "node", "left_anti")), "left")

    # all pairs across components that share a bucket
    rows = scratch.cut(left.join(traits, "node"), "rest")
    per_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    sizes = scratch.cut(per_root.groupBy("key").agg(F.sum("c").alias("members"), F.max(F.struct("c", "root")).alias("top")).select("key", "members", F.col("top.root").alias("main"), (F.col("members") - F.col("top.c")).alias("outside")), "sizes")
    small = sizes.where(F.col("members") <= SMALL).select("key")
    pairs = scratch.cut(_across(rows.join(small, "key", "left_semi")), "across")
    place = _merge(place, scratch.cut(_confirm(pairs, sets), "linked"), scratch)
    large = sizes.where(F.col("members") > SMALL)
    if large.limit(1).count():
        now = rows.drop("root").join(place, "node").select(rows.columns)
        place = _merge(place, scratch.cut(_large(now, sets, large), "linked"), scratch)

    # the smallest id of each component, back to every document by its digest
    owned = classes.select("node", "digest", "least_id").join(place, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = owned.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_digest = scratch.cut(owned.join(least, "root").select("digest", "component_id"), "named")
    scratch.keep_only(described, of_digest)
    base = described.select("_id", "_text_key", "n_shingles", "digest")
    out = base.join(of_digest, "digest", "left").withColumn("component_id", F.coalesce("component_id", "_id"))
    return out.select("_id", "_text_key", "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id and kept."""
    return _linked(docs, id_col, text_col, width).select(F.col("_id").alias(id_col), "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row (rows, if repeated) with its
    smallest id.  Rows with a null id stay only if their component has no other id.  The verdict
    goes by id and text, so it holds for rows whose id is null or belongs to other texts too."""
    kept_id, kept_key = unused(docs.columns, "_kept_id", "_kept_key")
    rows = _linked(docs.select(id_col, text_col), id_col, text_col, width).where("kept")
    stay = rows.select(F.col("_id").alias(kept_id), F.col("_text_key").alias(kept_key)).distinct()
    return docs.join(stay, (_text_key(text_col) == F.col(kept_key)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
