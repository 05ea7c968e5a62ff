"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between, lower-cased
and hashed into 2^``DIM_BITS`` places.  Training runs over a bounded sample of labelled documents
(``SAMPLE`` per class, least in a hash of the id, and of these as many as have ``SAMPLE_PLACES``
features together) with a rate per coordinate and an L1 term that leaves most weights at exactly
zero; the few others travel in the closure as index and value.

Defined results: null and empty texts score the prior (the bias alone); repeated rows get equal
scores; other columns pass through and columns named score or predicted are replaced; labels
that are null or neither 0 nor 1 are not learned, a document labelled both 0 and 1 counts once
for each; without any label every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec

DIM_BITS = 20
SAMPLE = 4_000
#: Most features of the sample of a class (4 bytes each): a bound on what reaches the driver.
SAMPLE_PLACES = 8_000_000
PASSES = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 20.0, 1.0
_KIND = textvec.mix(np.arange(1, 4, dtype=np.uint64))


@dataclass
class Model:
    """Non-zero weights by place, in order, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << DIM_BITS, np.float32)
        out[self.at] = self.weight
        return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of some rows, with their rows (not in order, with repeats)."""
    h, first = textvec.words(data, offsets, textvec.NOT_ALNUM)
    row = textvec.rows_of(first)
    out, rows = [textvec.mix(h ^ _KIND[0])], [row]
    for kind, gap in ((1, 1), (2, 2)):
        if len(h) > gap:
            ok = row[:-gap] == row[gap:]
            out.append(textvec.mix(h[:-gap][ok] * textvec.PLACE[kind] + h[gap:][ok] * textvec.PLACE[kind + 3] + _KIND[kind]))
            rows.append(row[gap:][ok])
    return (np.concatenate(out) >> np.uint64(64 - DIM_BITS)).astype(np.int64), np.concatenate(rows)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, order and the distinct feature places of each text, 4 bytes each."""
    for batch in batches:
        data, offsets = textvec.buffer_of(batch.column(2))
        for lo, hi in textvec.chunks(offsets):
            at, row = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            order = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[order], np.arange(hi - lo + 1))
            own = [np.unique(at[order[a:b]]).astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "k", "at"])


def fit(samples: list[tuple[int, np.ndarray]], passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal over (label, distinct places), in the order given, some times over."""
    size = 1 << DIM_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    weigh = np.array([0.0, 0.0])
    counts = np.bincount([y for y, _ in samples], minlength=2) if samples else np.array([0, 0])
    if samples:
        weigh = len(samples) / (2.0 * np.maximum(counts, 1))

    def weights(i: np.ndarray) -> np.ndarray:
        shrink = l1 * (i < size)  # the bias has no penalty
        far = np.sign(z[i]) * np.maximum(np.abs(z[i]) - shrink, 0)
        return -far / ((beta + np.sqrt(n[i])) / alpha + l2 * (i < size))

    for _ in range(passes):
        for y, at in samples:
            i = np.append(at, size)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - y) * weigh[y]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    every = weights(np.arange(size + 1))
    at = np.flatnonzero(every[:-1])
    return Model(at.astype(np.int32), every[at].astype(np.float32), float(every[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the rows of ``labels`` and the texts of ``docs``.

    The sample of ids is bounded, so it is broadcast to the scan of texts; what reaches the
    driver are the hashed features of at most twice ``sample`` documents.
    """
    own = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("label")).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).distinct().withColumn("k", F.xxhash64(F.lit(11), "_i"))
    parts = [own.where(F.col("label") == y).orderBy("k", "_i").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_i").select("label", "k", "text")
    places = texts.mapInArrow(_distinct, "label int, k long, at binary")
    so_far = F.sum(F.length("at") / 4).over(W.partitionBy("label").orderBy("k", "at").rowsBetween(W.unboundedPreceding, 0))
    few = places.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_PLACES).select("label", "k", "at")
    rows = sorted(((r["k"], r["label"], bytes(r["at"])) for r in few.toLocalIterator()))
    return fit([(y, np.frombuffer(at, "<i4")) for _, y, at in rows])


def margins(model: Model, dense: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the weights of each row's distinct features, and the bias."""
    at, row = features(data, offsets)
    w = dense[at]
    hit = np.flatnonzero(w)  # few places have a weight, so distinct features are found among those
    key = np.unique((row[hit].astype(np.int64) << DIM_BITS) | at[hit])
    return model.bias + np.bincount(key >> DIM_BITS, weights=dense[key & ((1 << DIM_BITS) - 1)], minlength=len(offsets) - 1)


def _scorer(model: Model) -> Callable:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = model.dense()
        for series in texts:
            data, offsets = textvec.buffer_of(pa.array(series, pa.large_string(), from_pandas=True))
            out = np.zeros(len(series))
            for lo, hi in textvec.chunks(offsets):
                out[lo:hi] = margins(model, dense, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with score (0 to 1) and predicted (1 if score >= 0.5)."""
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*rest, F.pandas_udf(_scorer(model), "double")(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
