"""Target-distribution importance resampling over hashed word n-grams, by external sort-count.

Features are all runs of 1 to ``RUNS`` words; a feature's bucket is the crc32 of its bytes modulo
``BUCKETS``, which fits 16 bits.

1. One pass over the texts writes packed streams: blocks of bucket numbers of two bytes each, with
   the rows they belong to and the offsets where each row's features begin.  A text longer than a
   block goes on in the next one.
2. Counts: a block's stream is sorted and run-length encoded, and runs are added up by bucket: a
   table of ``BUCKETS`` rows, whatever the input.  The target's counts are made likewise.
3. Gains: the log ratio of the smoothed shares of a bucket in target and corpus, in thousandths.
   They are gathered by the streams and summed per row with ``np.add.reduceat``; a row's weight is
   its mean gain, rounded down.
4. Gumbel noise seeded by the id turns weights into scores, so the highest scores are a weighted
   sample without replacement.  Scores are numbered by ranges of their order (no task sorts them
   all), and the first ``share`` of the rows with enough words are drawn.

Texts are read once; the streams take about two thirds of their size on disk, in the shared folder.
To the driver go two tables of at most ``BUCKETS`` counts and one number of rows.

Defined results: null, empty and wordless texts have no features, weight 0 and are never drawn; a
null id scores like the text "null"; repeated rows are rows of their own with equal scores, ties
going to the smaller id; an empty target gives gains by smoothing alone; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import numbered
from ..runtime import Scratch
from . import textvec

BUCKETS = 10_000
RUNS = 2
SEED = 7
SHARE = 25
LEAST_WORDS = 20
#: Bytes of a word up to which all words of a block are taken together, a place at a time.
NEAR = 32


def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial EDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of what has the crc32s ``state``, followed by these runs of ``data``.

    The runs are taken together, a byte of each at a time; the few beyond ``NEAR`` bytes alone.
    """
    short = np.minimum(length, NEAR + 1).astype(np.int16)
    order = np.argsort(-short, kind="stable")
    alive = np.searchsorted(-short[order], -np.arange(1, NEAR + 2), "right")  # runs longer than k
    at, held = starts[order], ~state[order]
    for k, n in enumerate(alive[:NEAR]):
        held[:n] = _CRC[(held[:n] ^ data[at[:n] + k]) & 0xFF] ^ (held[:n] >> np.uint32(8))
    out = np.empty_like(held)
    out[order] = ~held
    for k in order[: alive[NEAR]].tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + length[k]].tobytes(), int(state[k]))
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of the words of some rows; ``data`` is in small letters."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends, _ = textvec.runs(data, edge, textvec.NOT_ALNUM)
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def stream(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some rows, row after row, and where each row's begin."""
    data = textvec._LOWER[data]
    starts, length, row = _words(data, offsets)
    parts, rows, state = [], [], np.zeros(len(starts), np.uint32)
    for k in range(runs):
        n = len(starts) - k
        if n <= 0:
            break
        ok = row[:n] == row[k:]
        if k:
            state = ~state[:n]
            state = ~(_CRC[(state ^ 0x20) & 0xFF] ^ (state >> np.uint32(8)))  # the space between
        state = crc_on(state, data, starts[k:], length[k:])
        parts.append((state[ok] % np.uint32(buckets)).astype(np.uint16))
        rows.append(row[:n][ok])
    if not parts:
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    every, of = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(of, kind="stable")
    return every[order], np.searchsorted(of[order], np.arange(len(offsets)))


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of one long text, each from the start of a word to the last start of a word in the
    ``CHUNK`` bytes behind it, so that a block's last word, with its end, opens the next."""
    lo = 0
    while len(data) - lo > 2 * textvec.CHUNK:
        size = textvec.CHUNK
        while True:
            part = ~textvec.NOT_ALNUM[data[lo : lo + size]]
            begins = np.flatnonzero(part[1:] & ~part[:-1]) + 1
            if len(begins) or lo + size >= len(data):
                break
            size *= 2  # a single word fills the block
        if not len(begins):
            break
        yield lo, lo + int(begins[-1])
        lo += int(begins[-1])
    yield lo, len(data)


def _long_stream(data: np.ndarray, buckets: int, runs: int) -> Iterator[np.ndarray]:
    """The features of one long text, block by block; runs that cross into the next block are taken
    with its first words."""
    tail = np.zeros(0, np.uint8)
    for lo, hi in _cuts(data):
        own, _ = stream(data[lo:hi], np.array([0, hi - lo]), buckets, runs)
        parts = [own]
        if len(tail) and runs > 1:
            head = _edge(data[lo:hi], runs - 1, False)
            both = np.concatenate((tail, np.array([0x20], np.uint8), head))
            of = lambda x: stream(x, np.array([0, len(x)]), buckets, runs)[0]
            crossing = np.bincount(of(both), minlength=buckets) - np.bincount(of(tail), minlength=buckets) - np.bincount(of(head), minlength=buckets)
            parts.append(np.repeat(np.arange(buckets), crossing).astype(np.uint16))
        yield np.concatenate(parts)
        joined = np.concatenate((tail, np.array([0x20], np.uint8), _edge(data[lo:hi], runs - 1, True))) if runs > 1 else tail
        tail = _edge(joined, runs - 1, True) if runs > 1 else tail


def _edge(data: np.ndarray, count: int, last: bool) -> np.ndarray:
    """The bytes of the first or last ``count`` words of a block (fewer, if it has fewer)."""
    starts, ends, _ = textvec.runs(data, np.zeros(len(data) + 1, bool), textvec.NOT_ALNUM)
    if not len(starts):
        return np.zeros(0, np.uint8)
    return data[starts[-min(count, len(starts))] : ends[-1]] if last else data[starts[0] : ends[min(count, len(starts)) - 1]]


def _streams(buckets: int, runs: int) -> Callable:
    """Blocks of packed streams: the buckets, the rows, their ids and where each row's buckets begin."""

    def packed(own: np.ndarray, keys: list[pa.Array], at: np.ndarray) -> pa.RecordBatch:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), *map(one, keys), one(pa.array(at, pa.int64()))], ["block", "rows", "ids", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.buffer_of(batch.column(2))
            for lo, hi in textvec.chunks(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                keys = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                if len(part) > 2 * textvec.CHUNK:  # one long text
                    for own in _long_stream(part, buckets, runs):
                        yield packed(own, keys, np.array([0, len(own)]))
                else:
                    own, at = stream(part, off, buckets, runs)
                    yield packed(own, keys, at)

    return run


def streams(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """Packed streams of the texts of ``docs``, whose rows are numbered."""
    if buckets > 1 << 16:
        raise ValueError("a bucket has 16 bits")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in (("rows", T.LongType()), ("ids", slim.schema["id"].dataType), ("offsets", T.LongType()))]
    return slim.mapInArrow(_streams(buckets, runs), T.StructType([T.StructField("block", T.BinaryType()), *lists]))


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted and run-length encoded streams, one batch's runs added up."""
    for batch in batches:
        parts = []
        for block in batch.column(0):
            own = np.sort(np.frombuffer(block.as_buffer(), np.uint16))
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
            parts.append((own[first], np.diff(np.append(first, len(own)))))
        bucket = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0, np.uint16)
        n = np.bincount(bucket, weights=np.concatenate([c for _, c in parts]) if parts else None)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["bucket", "n"])


def counts(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in some streams."""
    out = np.zeros(buckets, np.int64)
    for r in blocks.select("block").mapInArrow(_run_lengths, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    n = len(corpus)
    above = (target + 1).astype(np.float64) * float(corpus.sum() + n)
    below = (corpus + 1).astype(np.float64) * float(target.sum() + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _gather(gain: np.ndarray) -> Callable:
    """Per row of a block: number and sum of gains of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, ids, offsets = (batch.column(c)[k].values for c in (1, 2, 3))
                at = offsets.to_numpy(zero_copy_only=False)
                own = gain[np.frombuffer(batch.column(0)[k].as_buffer(), np.uint16)]
                n, total = np.diff(at), np.zeros(len(rows), np.int64)
                some = np.flatnonzero(n)  # reduceat has no empty segments
                if len(some):
                    total[some] = np.add.reduceat(own, at[some])
                yield pa.RecordBatch.from_arrays([rows, ids, pa.array(n), pa.array(total)], ["row", "doc_id", "n", "total"])

    return run


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 * a standard Gumbel value) drawn by the sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, runs: int = RUNS, scratch: Scratch | None = None) -> DataFrame:
    """Every row's id (as doc_id), n_features, weight, score and rank: rank is null but for the
    ``share`` per cent of the rows of ``least_words`` words or more that are drawn."""
    scratch = scratch or Scratch(docs.sparkSession, "importance")
    blocks = scratch.cut(streams(docs, id_col, text_col, buckets, runs), "streams")
    wanted = streams(target.select(F.col(target_col).alias("text"), F.lit(0).alias("id")), "id", "text", buckets, runs)
    gain = gains(counts(blocks, buckets), counts(wanted, buckets))
    kinds = [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "total"))]
    summed = blocks.mapInArrow(_gather(gain), T.StructType([T.StructField("row", T.LongType()), *kinds])).groupBy("row", "doc_id").agg(F.sum("n").alias("n_features"), F.sum("total").alias("total"))
    weight = F.coalesce(F.expr("(total - pmod(total, n_features)) div nullif(n_features, 0)"), F.lit(0)).cast("long")
    scored = summed.select("row", "doc_id", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scratch.cut(scored, "scored")
    # runs of 1 to R words: a row of w words has w + (w - 1) + ... features
    least = sum(max(0, least_words - k) for k in range(runs))
    asked = scored.where(F.col("n_features") >= least)
    drawn = share * asked.count() // 100
    placed = numbered(asked.select("row", "score", "doc_id"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], "rank", scratch)
    top = placed.where(F.col("rank") <= drawn).select("row", "rank")
    return scored.join(top, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
