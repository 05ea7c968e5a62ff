"""Similarity join of 64-bit hashes at any Hamming radius.

Equal hashes (with equal variants) are one class, and classes are joined, so a hash that many files
share (a blank picture) is compared once.  Pairs of classes are found

- for radii up to 9 and many classes, in bands (``blocking.band_plan``): what shares a band's value is
  compared inside a task;
- else in metric partitions: each hash belongs to the cell of its nearest pivot, and a probe goes to
  the cells that the triangle inequality leaves open for it.  Cells are cut into blocks, and a task
  compares two blocks and emits links only: no row stands for a pair that was merely compared.

``hamming_pairs`` expands classes to all pairs of files; ``candidates`` does so for small ones only
and links the members of large ones with their neighbours in capture time.  ``cosine_pairs`` takes the
vectors to the tasks that compare hashes, so no vector is sent for a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import options as K
from ..functions import hashing, names
from ..functions.text import micros
from ..options import Options
from ..runtime import Scratch
from .ranking import numbered

#: Most pivots, and the hashes they are chosen from; rows of a block.
PIVOTS, SAMPLE, BLOCK = 128, 4096, 2048
#: Widest radius of the band join; entries of a cell of it, entries or pairs that a task holds at once, and
#: pairs of one value beyond which they are compared as a block.
BANDED = 9
CELL, ENTRIES, MANY = 1 << 15, 1 << 19, 1 << 12
#: Pairs of files up to which a class, or two linked ones, are expanded by ``candidates``.
EXPANDED = 4096
#: Parts that vectors are dealt into, and rows of a part beyond which there are more; rows of a tile in
#: which hashes are compared, and pairs whose cosines are taken at once.
PARTS, PART = 12, 1 << 16
TILE, TOGETHER = (256, 1024), 1 << 16
#: Rows of one capture order that a file looks ahead: more than there are files of one folder and
#: base name, which differ in their extension.
AHEAD = len(K.PHOTO_EXTENSIONS) + len(K.VIDEO_EXTENSIONS) + 1


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all pairs of two lists of hashes."""
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Hashes far from one another, farthest first, until all of the sample is near one."""
    if not len(sample):
        return np.zeros(1, np.int64)
    chosen = [int(sample[0])]
    near = bits_apart(sample, sample[:1])[:, 0]
    while len(chosen) < count and near.max() > 1:
        at = int(near.argmax())
        chosen.append(int(sample[at]))
        near = np.minimum(near, bits_apart(sample, sample[at : at + 1])[:, 0])
    return np.array(chosen, np.int64)


def _homes(pivots: np.ndarray) -> Callable:
    """(node, h) with the cell of the nearest pivot, the first of equals, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = bits_apart(batch.column(1).to_numpy(), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell].astype(np.int32))], ["node", "h", "cell", "apart"])

    return run


def _reached(pivots: np.ndarray, spans: np.ndarray, radius: int) -> Callable:
    """(qid, qh) once for each cell in which something may lie within the radius: a member of a cell is
    at most the cell's span from its pivot, and no nearer to another pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = bits_apart(batch.column(1).to_numpy(), pivots).astype(np.int64)
            may = (d <= spans[None, :] + radius) & (d <= d.min(1, keepdims=True) + 2 * radius) & (spans >= 0)[None, :]
            row, cell = np.nonzero(may)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.astype(np.int32))], ["qid", "qh", "cell"])

    return run


def _links(radius: int, once: bool) -> Callable:
    """Pairs of two blocks within the radius; ``once``: only those whose probe has the greater id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        node, h = (left[c].combine_chunks().to_numpy() for c in ("node", "h"))
        qid, qh = (right[c].combine_chunks().to_numpy() for c in ("qid", "qh"))
        a, b, d = [], [], []
        for lo in range(0, len(node), 256):
            apart = bits_apart(h[lo : lo + 256], qh)
            i, j = np.nonzero(apart <= radius)
            own, other = node[lo + i], qid[j]
            ok = other > own if once else other != own
            a.append(np.minimum(own, other)[ok])
            b.append(np.maximum(own, other)[ok])
            d.append(apart[i, j][ok].astype(np.int32))
        joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"a": joined(a, np.int64), "b": joined(b, np.int64), "distance": joined(d, np.int32)})

    return run


def _cells(rows: DataFrame, probes: DataFrame, radius: int, count: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, list]:
    """Rows and probes with their cells, and (cell, rows, probes) of each cell: as many as pivots."""
    pivots = np.zeros(1, np.int64)
    if count > BLOCK:
        found = rows.select("h").orderBy(F.xxhash64("h", F.lit(3)), "h").limit(SAMPLE).toLocalIterator()
        pivots = choose_pivots(np.array([r["h"] for r in found], np.int64), min(PIVOTS, -(-count // BLOCK) * 4))
    home = scratch.cut(rows.mapInArrow(_homes(pivots), "node long, h long, cell int, apart int"), "cells")
    spans, held = np.full(len(pivots), -1, np.int64), {}
    for r in home.groupBy("cell").agg(F.max("apart").alias("span"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
        spans[r["cell"]], held[r["cell"]] = r["span"], r["n"]
    sent = scratch.cut(probes.mapInArrow(_reached(pivots, spans, radius), "qid long, qh long, cell int"), "probes")
    asked = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    return home, sent, [(c, n, asked.get(c, 0)) for c, n in sorted(held.items())]


def metric_pairs(rows: DataFrame, probes: DataFrame, radius: int, once: bool, count: int, scratch: Scratch) -> DataFrame:
    """(a, b, distance) of ``rows`` (node, h; ``count`` of them) and ``probes`` (qid, qh) within the radius."""
    by = ["cell", "i", "j"]
    if count <= BLOCK:  # one block, met by the probes in eight parts
        x = rows.select(F.lit(0).alias("cell"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"), "node", "h")
        y = probes.select(F.lit(0).alias("cell"), F.lit(0).alias("i"), F.pmod(F.xxhash64("qh", F.lit(2)), F.lit(8)).cast("int").alias("j"), "qid", "qh")
        return x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(_links(radius, once), "a long, b long, distance int")
    home, sent, cells = _cells(rows, probes, radius, count, scratch)
    plan = [(c, -(-n // BLOCK), max(1, -(-m // BLOCK))) for c, n, m in cells]
    sizes = F.broadcast(rows.sparkSession.createDataFrame(plan or [(0, 1, 1)], "cell int, m int, k int"))  # a row a pivot
    part = lambda c, salt, n: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = home.join(sizes, "cell").withColumn("i", part("node", 1, "m")).withColumn("j", every("k")).select("cell", "i", "j", "node", "h").toDF("cell", "i", "j", "node", "h")
    y = sent.join(sizes, "cell").withColumn("j", part("qh", 2, "k")).withColumn("i", every("m")).select("cell", "i", "j", "qid", "qh").toDF("cell", "i", "j", "qid", "qh")
    return x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(_links(radius, once), "a long, b long, distance int")


def compared(left: DataFrame, distance: int, id_col: str = "file_id", hash_col: str = "hash") -> DataFrame:
    """(cell, rows, probes, compared) of the metric partitions of distinct hashes: the work of the join."""
    scratch = Scratch(left.sparkSession, "cells")
    own = scratch.cut(left.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("node")).select("node", "h"), "hashes")
    cells = _cells(own, own.toDF("qid", "qh"), distance, own.count(), scratch)[2]
    return left.sparkSession.createDataFrame([(c, n, m, n * m) for c, n, m in cells], "cell int, rows long, probes long, compared long")


def _values(h: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1 if width < 64 else 0xFFFF_FFFF_FFFF_FFFF)


def _entries(plan: list, bins: list[int], masked: bool, ids: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    """(cell, value, id, h) of hashes, once a band, or once a mask of a band: a band's values are dealt out
    to its cells, each of which has whole values."""
    first = 0
    for (shift, width, masks, _), n in zip(plan, bins, strict=True):
        own = np.array(masks if masked else [0], np.uint64)
        step = max(1, ENTRIES // len(own))
        for lo in range(0, len(h), step):
            value = (_values(h[lo : lo + step], shift, width)[:, None] ^ own[None, :]).ravel()
            cell = (value * np.uint64(0x9E37_79B9_7F4A_7C15) >> np.uint64(32)) % np.uint64(n)
            yield cell.astype(np.int64) + first, value.astype(np.int64), np.repeat(ids[lo : lo + step], len(own)), np.repeat(h[lo : lo + step], len(own))
        first += n


def _counted(plan: list, bins: list[int], masked: bool) -> Callable:
    """(cell, n) of the entries of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(sum(bins), np.int64)
        for batch in batches:
            for cell, *_ in _entries(plan, bins, masked, *(batch.column(k).to_numpy() for k in (0, 1))):
                held += np.bincount(cell, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["cell", "n"])

    return run


def _sent(plan: list, bins: list[int], masked: bool, parts: np.ndarray, others: np.ndarray, first: np.ndarray) -> Callable:
    """Entries for the block pairs of their cells: an entry lies in one of its side's ``parts`` and meets
    all ``others`` of the other side.  The last bit of ``key`` tells the side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, value, ids, h in _entries(plan, bins, masked, *(batch.column(k).to_numpy() for k in (0, 1))):
                mixed = (ids.view(np.uint64) ^ h.view(np.uint64) * np.uint64(3)) * np.uint64(0x9E37_79B9_7F4A_7C15) >> np.uint64(40)
                part, times = (mixed % parts[cell].astype(np.uint64)).astype(np.int64), others[cell]
                ends = np.cumsum(times)
                for lo in range(0, len(cell), ENTRIES):  # entries of a crowded cell are sent several times
                    hi = min(len(cell), lo + ENTRIES)
                    if times[lo:hi].max() == 1:
                        at, nth = np.arange(lo, hi), 0
                    else:
                        at = np.repeat(np.arange(lo, hi), times[lo:hi])
                        nth = np.arange(len(at)) - np.repeat(ends[lo:hi] - times[lo:hi] - (ends[lo] - times[lo]), times[lo:hi])
                    c = cell[at]
                    group = first[c] + (part[at] * others[c] + nth if masked else nth * parts[c] + part[at])
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(value[at] * 2 + (not masked)), pa.array(ids[at]), pa.array(h[at])], ["block", "key", "id", "h"])

    return run


def _same(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of equal values of two sorted lists, some at a time."""
    shared = np.intersect1d(x, y)
    xa, xb = np.searchsorted(x, shared), np.searchsorted(x, shared, "right")
    ya, yb = np.searchsorted(y, shared), np.searchsorted(y, shared, "right")
    pairs = (xb - xa) * (yb - ya)
    for k in np.flatnonzero(pairs > MANY):
        i, j = np.arange(xa[k], xb[k]), np.arange(ya[k], yb[k])
        step = max(1, ENTRIES // len(j))
        for lo in range(0, len(i), step):
            yield i[lo : lo + step, None], j[None, :]
    few = np.flatnonzero(pairs <= MANY)
    if not len(few):
        return
    ends = np.cumsum(pairs[few])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], ENTRIES)), len(few)))
    for lo, hi in pairwise(cuts):
        at = few[lo:hi]
        nth = np.arange(pairs[at].sum()) - np.repeat(np.cumsum(pairs[at]) - pairs[at], pairs[at])
        wide = np.repeat((yb - ya)[at], pairs[at])
        yield np.repeat(xa[at], pairs[at]) + nth // wide, np.repeat(ya[at], pairs[at]) + nth % wide


def _met(plan: list, first: np.ndarray, bands: np.ndarray, distance: int, once: bool) -> Callable:
    """Pairs of a block pair within the distance, each in the first band in which it is met."""
    parts = [(np.uint64(((1 << width) - 1) << shift), most) for shift, width, _, most in plan]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        value, ids, h = (held.column(c).combine_chunks().to_numpy() for c in ("key", "id", "h"))
        sides = []
        for side in (0, 1):
            at = np.flatnonzero((value & 1) == side)
            at = at[np.argsort(value[at], kind="stable")]
            sides.append((value[at] >> 1, ids[at], h[at].view(np.uint64)))
        (x, node, hx), (y, qid, hy) = sides
        band = bands[np.searchsorted(first, key[0].as_py(), "right") - 1]
        for i, j in _same(x, y):
            differ = hx[i] ^ hy[j]
            near = np.nonzero(np.bitwise_count(differ) <= distance)
            if not len(near[0]):
                continue
            differ = differ[near]
            own, other = np.broadcast_to(node[i], np.broadcast_shapes(i.shape, j.shape))[near], np.broadcast_to(qid[j], np.broadcast_shapes(i.shape, j.shape))[near]
            ok = other > own if once else other != own
            for bits, most in parts[:band]:
                ok &= np.bitwise_count(differ & bits) > most
            own, other = own[ok], other[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(np.bitwise_count(differ[ok]).astype(np.int32))], ["a", "b", "distance"])

    return run


def banded_pairs(rows: DataFrame, probes: DataFrame, distance: int, once: bool, count: int, asked: int) -> DataFrame:
    """(a, b, distance) of ``rows`` (node, h; ``count`` of them) and ``probes`` (qid, qh; ``asked``) within the
    distance, met in the bands of ``blocking.band_plan``.

    A band's values are dealt out to cells of about ``CELL`` entries, whose number grows with the hashes; a
    cell with more is cut into blocks, and tasks compare two blocks and emit links only."""
    from .blocking import band_plan

    plan = band_plan(distance, count, asked)
    bins = [max(1, min(2**width, -(-max(count * len(masks), asked) // CELL))) for _, width, masks, _ in plan]
    sizes = []
    for side, masked in ((rows, True), (probes, False)):
        held = np.zeros(sum(bins), np.int64)
        for r in side.mapInArrow(_counted(plan, bins, masked), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
            held[r["cell"]] = r["n"]
        sizes.append(np.maximum(1, -(-held // (2 * CELL))))
    m, k = sizes
    first = np.concatenate(([0], np.cumsum(m * k)))[:-1]
    x = rows.mapInArrow(_sent(plan, bins, True, m, k, first), "block long, key long, id long, h long")
    y = probes.mapInArrow(_sent(plan, bins, False, k, m, first), "block long, key long, id long, h long")
    of = np.repeat(np.arange(len(plan)), bins)
    return x.unionByName(y).groupBy("block").applyInArrow(_met(plan, first, of, distance, once), "a long, b long, distance int")


def class_pairs(own: DataFrame, distance: int, variants: bool, options: Options, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes (node, h, v, n, inner) of ``own`` (id, h, v), and pairs (a, b, distance) of their nodes.

    A class has one hash and one list of variants; its node is its least id, ``inner`` the distance
    of any two of its members."""
    inner = F.array_min(F.transform("v", lambda x: hashing.hamming(F.col("h"), x)))
    classes = scratch.cut(own.groupBy("h", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("inner", inner), "classes")
    rows, probes = classes.select("node", "h"), classes.select(F.col("node").alias("qid"), F.explode("v").alias("qh"))
    count = classes.count()
    if count <= options.brute_force_hashes or distance > BANDED:
        met = metric_pairs(rows, probes, distance, not variants, count, scratch)
    else:
        met = banded_pairs(rows, probes, distance, not variants, count, probes.count() if variants else count)
    if variants:  # a pair is met by several of them, and either way round
        met = met.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return classes, scratch.cut(met, "class-pairs")


def _own(left: DataFrame, id_col: str, hash_col: str, variants_col: str | None) -> DataFrame:
    """(id, h, v) of the rows with a hash."""
    v = F.array_distinct(F.col(variants_col)) if variants_col else F.array(F.col(hash_col))
    return left.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), v.alias("v"))


def _expanded(own: DataFrame, many: DataFrame, pairs: DataFrame, distance: int, inside: DataFrame) -> DataFrame:
    """``pairs`` of nodes as pairs of members (of ``many``, the classes of several), and all pairs of
    members of the classes ``inside``."""
    members = own.join(many.select("h", "v", "node"), ["h", "v"]).select("node", "id")
    ends = lambda side: members.toDF(side, f"_{side}")
    across = pairs.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "distance")
    within = members.join(inside.where(F.col("inner") <= distance).select("node", F.col("inner").alias("distance")), "node")
    within = within.toDF("node", "a", "distance").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))  # a class may hold many files
    parts = members.toDF("node", "b").withColumn("part", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    within = within.join(parts, ["node", "part"]).where("a < b").select("a", "b", "distance")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").unionByName(within)


def hamming_pairs(left: DataFrame, distance: int, id_col: str = "file_id", hash_col: str = "hash", variants_col: str | None = None, options: Options | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, distance) with a < b: all pairs whose hashes (or, with variants, one's hash and the
    other's variants, either way round) differ in at most ``distance`` bits.  Null hashes take no
    part; the result has every pair of equal hashes."""
    scratch = scratch or Scratch(left.sparkSession, "hamming")
    own = scratch.cut(_own(left, id_col, hash_col, variants_col), "hashes")
    classes, pairs = class_pairs(own, distance, variants_col is not None, options or Options(), scratch)
    many = classes.where("n > 1")
    if not many.limit(1).count():
        return pairs
    return _expanded(own, many, pairs, distance, many)


def vector_parts(count: int) -> int:
    """Parts of so many vectors, each of which is sent once a part: a fixed number, so what is shuffled
    follows the rows, until a part would hold more than a task should (``PARTS * PART`` rows)."""
    return 1 if count <= BLOCK else max(PARTS, -(-count // PART))


def _columns(v: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of vectors as rows, padded with zeros, and the vectors' lengths: -1 where one is missing, empty
    or lacks a value."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = v.value_lengths().fill_null(0).to_numpy()
    flat = v.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((max(1, sizes.max(initial=0)), len(sizes)), np.float32 if flat.type == pa.float32() else np.float64)
    out[place, row] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    lacking = np.bincount(row[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(sizes)) > 0
    return out, np.where((sizes == 0) | lacking, -1, sizes)


def _near(h: np.ndarray, left: np.ndarray, right: np.ndarray, pivots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the places of ``left`` and ``right`` whose hashes are within the radius.  What is
    nearest to one pivot is compared with what the triangle inequality leaves open for it."""
    apart = bits_apart(h[left], pivots)
    cell, apart = apart.argmin(1), apart.min(1).astype(np.int64)
    reach = bits_apart(h[right], pivots).astype(np.int16)
    nearest = reach.min(1)
    for c in np.unique(cell):
        own = left[cell == c]
        met = right[(reach[:, c] <= apart[cell == c].max() + radius) & (reach[:, c] <= nearest + 2 * radius)]
        for lo in range(0, len(own), TILE[0]):
            i = own[lo : lo + TILE[0]]
            for at in range(0, len(met), TILE[1]):
                j = met[at : at + TILE[1]]
                d = bits_apart(h[i], h[j]).ravel()
                found = np.flatnonzero(d <= radius)
                if len(found):
                    yield i[found // len(j)], j[found % len(j)], d[found]


def _vector_links(pivots: np.ndarray, radius: int) -> Callable:
    """(a, b, distance, cosine) of two parts, or within one, a bounded number at a time."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        part, ids, h = (held.column(c).combine_chunks().to_numpy() for c in ("part", "id", "h"))
        columns, sizes = _columns(held.column("v"))
        lo, hi = (k.as_py() for k in key)
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)

        def cosines(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            sums = np.zeros(len(i))
            for values in columns:  # place by place, the order in which a row's sum is taken
                sums += values[i].astype(np.float64) * values[j]
            missing = (sizes[i] != sizes[j]) | (sizes[i] < 0)
            ends = ids[i], ids[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends)), pa.array(d.astype(np.int32)), pa.array(sums, mask=missing, from_pandas=False)], ["a", "b", "distance", "cosine"])

        waiting, n = [], 0
        for i, j, d in _near(h, left, right, pivots, radius):
            ok = ids[i] < ids[j] if lo == hi else ids[i] != ids[j]
            waiting.append((i[ok], j[ok], d[ok]))
            n += len(waiting[-1][0])
            if n >= TOGETHER:
                yield cosines(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, n = [], 0
        if n:
            yield cosines(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    return run


def cosine_pairs(hashes: DataFrame, vectors: DataFrame, distance: int, id_col: str = "file_id", hash_col: str = "hash", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """(a, b, distance, cosine): the pairs of ``hamming_pairs`` whose files have a row in ``vectors``, with
    the dot product of their vectors (null as in ``functions.vectors.cosine``).

    The pairs are by nature a share of all pairs, so none is stored or joined: rows are dealt into parts
    by id, two parts meet in a task, and the task emits links with their cosines.  A row is sent once a
    part, however many links it has and whatever its hash."""
    scratch = scratch or Scratch(hashes.sparkSession, "cosines")
    own = scratch.cut(hashes.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")), "hashes")
    count, pivots = own.count(), np.zeros(1, np.int64)
    if count > BLOCK:
        found = own.select("h").distinct().orderBy(F.xxhash64("h", F.lit(3)), "h").limit(SAMPLE).toLocalIterator()
        pivots = choose_pivots(np.array([r["h"] for r in found], np.int64), PIVOTS)
    parts = vector_parts(count)
    rows = own.join(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = rows.select(F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "h", "v")
    return met.groupBy("lo", "hi").applyInArrow(_vector_links(pivots, distance), "a long, b long, distance int, cosine double")


def capture_links(members: DataFrame, within_us: int = K.DISTINCT_CAPTURE_US, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) that connect what all pairs of a ``group`` would connect, if pairs count that are at most
    ``within_us`` apart or lack a time, and are not RAW and other file of one ``base``.  Columns: group,
    id, us, base, raw; linear in the rows.

    In time order a file is linked with the next and the last one of another base, and the next of its
    own base and kind: if two files may be linked, those between them lead from one to the other.
    Files without a time are linked to all: up to three of them (two bases, both kinds) stand for
    the rest.
    """
    scratch = scratch or Scratch(members.sparkSession, "captures")
    members = scratch.cut(members.select("group", "id", "us", "base", "raw"), "members")
    placed = scratch.cut(numbered(members.where("us is not null"), ["group", "us", "id"], "n", scratch), "numbered").withColumn("block", F.floor(F.col("n") / AHEAD).cast("long"))
    later = placed.select("group", *[F.col(c).alias(f"{c}2") for c in ("id", "us", "base", "raw", "n")], F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    met = placed.join(later, ["group", "block"]).where((F.col("n2") > F.col("n")) & (F.col("n2") - F.col("n") <= AHEAD) & (F.col("us2") - F.col("us") <= within_us))
    met = scratch.cut(met.select("id", "id2", "n", "n2", (F.col("base") == F.col("base2")).alias("own"), (F.col("raw") == F.col("raw2")).alias("kind"), "group"), "ahead")
    ahead = met.groupBy("group", "id").agg(F.min_by("id2", F.when(~F.col("own"), F.col("n2"))).alias("x"), F.min_by("id2", F.when(F.col("own") & F.col("kind"), F.col("n2"))).alias("y"))
    back = met.where(~F.col("own")).groupBy("group", "id2").agg(F.max_by("id", "n").alias("x"))
    dated = ahead.select(F.col("id").alias("a"), F.explode(F.array("x", "y")).alias("b")).where("b is not null").unionByName(back.select(F.col("id2").alias("a"), F.col("x").alias("b")))

    none = members.where("us is null")
    first = none.groupBy("group").agg(F.min_by(F.struct("id", "base", "raw"), "id").alias("f"))
    others = none.join(first, "group").groupBy("group", "f").agg(
        F.min_by("id", F.when(F.col("base") != F.col("f.base"), F.col("id"))).alias("x"), F.min_by("id", F.when((F.col("base") == F.col("f.base")) & (F.col("raw") != F.col("f.raw")), F.col("id"))).alias("y"),
    )
    hubs = others.select("group", F.explode(F.array("f.id", "x", "y")).alias("a")).where("a is not null")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))  # a group may hold a third of all rows
    undated = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(hubs, ["group", "part"]).select("a", F.col("id").alias("b"))
    both = dated.unionByName(undated).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def captures(files: DataFrame, group: Column) -> DataFrame:
    """The columns of ``capture_links`` of a files table."""
    base = F.upper(F.concat(names.directory(F.col("path")), F.lit("/"), names.base_name(F.col("path"))))
    return files.select(group.alias("group"), F.col("file_id").alias("id"), micros(F.col("taken_at")).alias("us"), base.alias("base"), names.extension(F.col("path")).isin(*K.RAW_EXTENSIONS).alias("raw"))


def candidates(files: DataFrame, distance: int, options: Options | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``files`` (file_id, path, taken_at, phash) to score, and (group, file_id) of the
    members of large classes.

    Classes and linked classes of at most ``EXPANDED`` pairs give all their pairs; larger ones give
    ``capture_links``, which connect the same components by the rule on capture times in a number
    of rows linear in the files (a class pair counts the files of both).
    """
    o = options or Options()
    scratch = scratch or Scratch(files.sparkSession, "candidates")
    held = scratch.cut(files.where("phash is not null").select("file_id", "path", "taken_at", F.get("phash", F.lit(0)).alias("h"), F.array_distinct("phash").alias("v")), "hashes")
    own = held.select(F.col("file_id").alias("id"), "h", "v")
    classes, pairs = class_pairs(own, distance, True, o, scratch)
    many = classes.where("n > 1")
    if not many.limit(1).count():
        return pairs.select("a", "b"), held.sparkSession.createDataFrame([], "group string, file_id long")
    size = lambda side: classes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"))
    sized = scratch.cut(pairs.join(size("a"), "a").join(size("b"), "b").withColumn("large", F.col("na") * F.col("nb") > EXPANDED), "sized")
    small = _expanded(own, many, sized.where("not large").select("a", "b", "distance"), distance, many.where(F.col("n") * (F.col("n") - 1) / 2 <= EXPANDED)).select("a", "b")
    large = many.where(F.col("n") * (F.col("n") - 1) / 2 > EXPANDED).select("node", F.col("node").cast("string").alias("group"))
    pairs_of = sized.where("large").select(F.explode(F.array("a", "b")).alias("node"), F.concat_ws(":", "a", "b").alias("group"))
    groups = classes.select("node", "h", "v").join(scratch.cut(large.unionByName(pairs_of), "groups"), "node")
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))  # a class may hold a third of all files
    told = held.withColumn("part", F.pmod(F.xxhash64("file_id"), F.lit(16)).cast("int")).join(parts, ["h", "v", "part"])
    crowd = scratch.cut(told.select("group", "file_id", "path", "taken_at"), "crowd")
    linked = capture_links(captures(crowd, F.col("group")), scratch=scratch)
    return scratch.cut(small.unionByName(linked).distinct(), "near"), crowd.select("group", "file_id")
