"""Edit-distance join of names by a positional q-gram prefix filter.

All pairs of a left and a right name within ``edits`` insertions, deletions, substitutions and
exchanges of adjacent code points (unrestricted Damerau-Levenshtein distance) are found:

1. Only distinct names take part, so a name that a third of the rows has is one name.
2. Grams of ``GRAM`` code points are counted over the names of both sides, by ``2^BUCKET_BITS``
   hash buckets: a table of constant size.  Grams are ordered rare first: by their bucket's count,
   ties by their hash, which is one order for all names.
3. An edit destroys at most ``GRAM`` + 1 grams of a name: an exchange touches two places, so one
   gram more than the others.  With t = edits * (``GRAM`` + 1), two names within ``edits`` of which
   one has more than t grams share a surviving gram among the first t + 1 of either; a tie at the
   end of such a prefix (a gram that occurs again) is taken in whole, so the shared gram may be
   asked to be the surviving one.  That one is shifted by s and the lengths differ by d with
   abs(s) + abs(d - s) <= edits.  Grams, places and lengths are therefore one key of an inverted
   index: the right side asks for every (s, d), and the join is a plain equi-join.
4. Joined rows must differ in at most 2 * edits bits of the parities of their characters (a
   character count filter inside the join), then keep enough grams in place (count filter), then
   pass a banded dynamic programme over whole batches of pairs.
5. Two names that both have t grams or fewer share no gram for certain: they are compared by
   length buckets, in blocks of ``BLOCK`` names on either side, inside the tasks.

Keys with more than ``HOT`` left names are split by a hash of the name, and only right names that ask
for such a key are repeated for its parts.  All joins of names are by sort and merge, so that no table
that grows is broadcast.  To the driver go the gram counts (a constant size) and
the counts of short names by length.

Defined results: null and empty names take no part; repeated names count once in ``join`` and
with all their rows in ``matches``; only the named columns are read, so others may have any name;
empty tables give an empty result; names may have any length and any characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .textvec import mix

GRAM = 3
BUCKET_BITS = 16
HOT = 256
BLOCK = 512
#: Most cells (pairs times code points) that are compared at a time.
CELLS = 1 << 20
#: Parts by which matched rows of one name are dealt out.
SALTS = 16

_PLACE = np.random.default_rng(13).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def normal(name: Column) -> Column:
    """A-Z in small letters, and no white space; null if nothing is left."""
    text = F.regexp_replace(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]", "")
    return F.nullif(text, F.lit(""))


def code_points(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all names on end, and where each begins (one more entry)."""
    texts = names.to_pylist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(size)))


def grams(points: np.ndarray, at: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, name and place of every gram."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = mix(h ^ (points[j : j + n].astype(np.uint64) * _PLACE[j]))
    ok = row[:n] == row[q - 1 :]
    place = np.arange(n) - at[row[:n]]
    return h[ok], row[:n][ok], place[ok]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(q: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(grams(*code_points(batch.column(0)), q)[0]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def gram_counts(names: DataFrame, q: int = GRAM) -> np.ndarray:
    """How often the grams of each bucket occur in ``names`` (one column)."""
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in names.mapInArrow(_counts(q), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def prefix(points: np.ndarray, at: np.ndarray, counts: np.ndarray, edits: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, name and place of the grams in each name's prefix, ties at its end included."""
    h, row, place = grams(points, at, q)
    rank = counts[_bucket(h)]
    order = np.lexsort((h, rank, row))
    h, row, place, rank = h[order], row[order], place[order], rank[order]
    first = np.searchsorted(row, np.arange(len(at)))
    last = np.minimum(first[:-1] + edits * (q + 1), first[1:] - 1)  # the last gram of a name's prefix
    held = last[row]
    ok = (rank < rank[held]) | ((rank == rank[held]) & (h <= h[held]))
    return h[ok], row[ok], place[ok]


def shifts(edits: int) -> list[tuple[int, int]]:
    """Shifts of a surviving gram with the differences of length they allow."""
    span = range(-edits, edits + 1)
    return [(s, d) for s in span for d in span if abs(s) + abs(d - s) <= edits]


def parity(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits per name, each the parity of the number of characters of its class.  An edit changes
    two bits at most, an exchange none."""
    bit = np.uint64(1) << (mix(points.astype(np.uint64) + np.uint64(1)) >> np.uint64(58))
    run = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bit)))
    return run[at[1:]] ^ run[at[:-1]]


def _entries(counts: np.ndarray, edits: int, q: int, asked: list[tuple[int, int]]) -> Callable:
    """Index rows of (node, name): key, node and parity, one for each gram of the prefix and each of
    the shifts asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, at = code_points(batch.column(1))
            h, row, place = prefix(points, at, counts, edits, q)
            size, bits = np.diff(at), parity(points, at).astype(np.int64)
            node = batch.column(0).to_numpy()
            for s, d in asked:
                key = mix(h + mix((place + s).astype(np.uint64) * _PLACE[q] + (size[row] + d).astype(np.uint64) * _PLACE[q + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.astype(np.int64), node[row], bits[row])], ["key", "node", "bits"])

    return run


def _padded(points: np.ndarray, at: np.ndarray, some: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Code points of some names as rows of a table (names x width)."""
    size = at[some + 1] - at[some]
    place = np.arange(width)[None, :]
    out = np.full((len(some), width), fill, np.int64)
    inside = place < size[:, None]
    out[inside] = points[(at[some][:, None] + place)[inside]]
    return out


def distances(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, edits: int) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of pairs of padded rows, ``edits`` + 1 for more.

    Only cells within ``edits`` of the diagonal are held: cell [i, o] of a pair is the distance of
    the first i code points of a and the first i + o - edits of b.  An exchange may have g code
    points of a deleted and f of b inserted between its two, at a cost of g + f + 1.
    """
    n, band, pairs = a.shape[1], 2 * edits + 1, len(a)
    far = edits + 1
    table = np.full((n + 1, band, pairs), far, np.int16)
    for i in range(n + 1):
        for o in range(band):
            j = i + o - edits
            if j < 0 or j > b.shape[1]:
                continue
            if i == 0 or j == 0:
                table[i, o] = min(i + j, far)
                continue
            best = table[i - 1, o] + (a[:, i - 1] != b[:, j - 1])
            if o + 1 < band:
                np.minimum(best, table[i - 1, o + 1] + 1, out=best)
            if o:
                np.minimum(best, table[i, o - 1] + 1, out=best)
            for g in range(edits):
                for f in range(edits - g):
                    p, r = i - 2 - g, j - 2 - f  # before the exchanged ones
                    if p >= 0 and r >= 0 and 0 <= r - p + edits < band:
                        crossed = (a[:, p] == b[:, j - 1]) & (b[:, r] == a[:, i - 1])
                        np.minimum(best, np.where(crossed, table[p, r - p + edits] + g + f + 1, far), out=best)
            table[i, o] = np.minimum(best, far)
    o = size_b - size_a + edits
    ok = (o >= 0) & (o < band)
    return np.where(ok, table[size_a, np.clip(o, 0, band - 1), np.arange(pairs)], far)


def _in_place(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, edits: int, q: int) -> np.ndarray:
    """Whether enough grams of a's rows are found in b's, shifted by ``edits`` at most."""
    n = a.shape[1] - q + 1
    if n <= 0:
        return np.ones(len(a), bool)
    held = np.zeros((len(a), n), bool)
    for s in range(-edits, edits + 1):
        same = np.zeros(a.shape, bool)
        lo, hi = max(0, -s), min(a.shape[1], b.shape[1] - s)
        if hi - lo >= q:
            same[:, lo:hi] = a[:, lo:hi] == b[:, lo + s : hi + s]
            run = same[:, :n].copy()
            for j in range(1, q):
                run &= same[:, j : j + n]
            held |= run
    return held.sum(1) >= np.maximum(size_a, size_b) - q + 1 - edits * (q + 1)


def _close(points_a: np.ndarray, at_a: np.ndarray, i: np.ndarray, points_b: np.ndarray, at_b: np.ndarray, j: np.ndarray, edits: int, q: int) -> np.ndarray:
    """Distances of the pairs (i, j) of two lists of names, ``edits`` + 1 for more."""
    size_a, size_b = at_a[i + 1] - at_a[i], at_b[j + 1] - at_b[j]
    out = np.full(len(i), edits + 1, np.int64)
    near = np.flatnonzero(np.abs(size_a - size_b) <= edits)
    near = near[np.argsort(size_a[near], kind="stable")]
    while len(near):
        width = max(int(size_a[near[: max(1, CELLS // 64)]].max()), 1)
        some = near[: max(1, CELLS // (width + edits))]
        near = near[len(some) :]
        sa, sb = size_a[some], size_b[some]
        width = int(max(sa.max(), sb.max()))
        a, b = _padded(points_a, at_a, i[some], width, -1), _padded(points_b, at_b, j[some], width, -2)
        may = _in_place(a, b, sa, sb, edits, q)
        out[some[may]] = distances(a[may], b[may], sa[may], sb[may], edits)
    return out


def _verify(edits: int, q: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (pa_, aa), (pb, ab) = code_points(batch.column(0)), code_points(batch.column(1))
            every = np.arange(batch.num_rows)
            d = _close(pa_, aa, every, pb, ab, every, edits, q)
            good = pa.array(np.flatnonzero(d <= edits))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good), pa.array(d[d <= edits].astype(np.int32))], ["left", "right", "distance"])

    return run


def _blocks(edits: int, q: int) -> Callable:
    """Pairs within ``edits`` of two blocks of short names."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["name"].combine_chunks(), right["name_"].combine_chunks()
        i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        if len(i):
            d = _close(*code_points(a), i, *code_points(b), j, edits, q)
            i, j, d = i[d <= edits], j[d <= edits], d[d <= edits]
        else:
            d = np.zeros(0, np.int64)
        return pa.table({"left": a.take(pa.array(i)), "right": b.take(pa.array(j)), "distance": pa.array(d.astype(np.int32))})

    return run


def most_short(edits: int, q: int) -> int:
    """Length up to which a name has so few grams that edits may leave none of them."""
    return q - 1 + edits * (q + 1)


def _short_pairs(left: DataFrame, right: DataFrame, edits: int, q: int) -> DataFrame | None:
    """Pairs of names that both have edits * (q + 1) grams or fewer, by length buckets."""
    few = lambda names: names.select("name").withColumn("size", F.char_length("name")).where(F.col("size") <= most_short(edits, q))
    a, b = few(left), few(right)
    held = {r["size"]: r["n"] for r in a.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each short length
    asked = {r["size"]: r["n"] for r in b.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not held or not asked:
        return None
    of = lambda n: -(-n // BLOCK)
    rows = [(s, t, of(held[s]), of(asked[t])) for s in held for t in asked if abs(s - t) <= edits]
    if not rows:
        return None
    plan = F.broadcast(left.sparkSession.createDataFrame(rows, "s int, t int, m int, n int"))  # pairs of short lengths
    own = lambda c, salt, n: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = a.join(plan, a["size"] == plan["s"]).withColumn("i", own("name", 1, "m")).withColumn("j", every("n")).select("s", "t", "i", "j", "name").toDF("s", "t", "i", "j", "name")
    y = b.join(plan, b["size"] == plan["t"]).withColumn("j", own("name", 2, "n")).withColumn("i", every("m")).select("s", "t", "i", "j", "name").toDF("s", "t", "i", "j", "name_")
    by = ["s", "t", "i", "j"]
    return x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(_blocks(edits, q), "left string, right string, distance int")


def join(left: DataFrame, right: DataFrame, edits: int = 1, q: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """(left, right, distance): every pair of a distinct name of ``left`` and one of ``right`` (tables
    of one string column ``name``) within ``edits``, each pair once."""
    if edits < 0 or q < 1 or q + 1 >= len(_PLACE):
        raise ValueError("edits must not be negative, and grams have 1 to 14 code points")
    scratch = scratch or Scratch(left.sparkSession, "names")
    named = lambda side: side.select("name").where("name <> ''").distinct().withColumn("node", F.monotonically_increasing_id()).select("node", "name")
    a, b = (scratch.cut(named(side), "distinct") for side in (left, right))
    counts = gram_counts(a.select("name").unionByName(b.select("name")), q)
    entry = "key long, node long, bits long"
    index = scratch.cut(a.mapInArrow(_entries(counts, edits, q, [(0, 0)]), entry), "index")
    probes = scratch.cut(b.mapInArrow(_entries(counts, edits, q, shifts(edits)), entry), "probes")
    # only keys that the right side asks for, hot ones in parts
    wanted = index.join(probes.select("key").distinct().hint("merge"), "key", "left_semi")
    hot = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    hot = scratch.cut(hot, "hot").hint("merge")
    parts = F.coalesce("parts", F.lit(1))
    x = index.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).select("key", "part", F.col("node").alias("a"), F.col("bits").alias("bits_a"))
    y = probes.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("key", "part", F.col("node").alias("b"), F.col("bits").alias("bits_b"))
    alike = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 2 * edits
    met = x.hint("merge").join(y, (x["key"] == y["key"]) & (x["part"] == y["part"]) & alike).select("a", "b").distinct()
    indexed = F.greatest(F.char_length("left"), F.char_length("right")) > most_short(edits, q)  # the others are compared below
    met = met.hint("merge").join(a.toDF("a", "left"), "a").join(b.toDF("b", "right").hint("merge"), "b").where(indexed).select("left", "right")
    found = met.mapInArrow(_verify(edits, q), "left string, right string, distance int")
    short = _short_pairs(a, b, edits, q)
    return found if short is None else found.unionByName(short)


def matches(left: DataFrame, right: DataFrame, edits: int = 1, q: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """(id, distance, n, first_id, ids_crc): for each row of ``right`` and distance with a match, the
    number of ``left`` rows, their smallest id and the sum of their ids' crc32.  Both tables have
    ``id`` and ``name``; a name's rows are added up before names are joined."""
    scratch = scratch or Scratch(left.sparkSession, "names")
    held = left.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum(F.crc32(F.col("id").cast("string"))).alias("ids_crc"))
    held = scratch.cut(held, "left")
    pairs = join(held, right, edits, q, scratch)
    summed = pairs.hint("merge").join(held.withColumnRenamed("name", "left"), "left").groupBy("right", "distance").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.sum("ids_crc").alias("ids_crc"))
    salted = summed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = right.select("id", F.col("name").alias("right"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_part"))
    met = rows.join(salted.hint("merge"), ["right", "_part"]).groupBy("id", "distance").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.sum("ids_crc").alias("ids_crc"))
    return met.select("id", "distance", "n", "first_id", "ids_crc")
