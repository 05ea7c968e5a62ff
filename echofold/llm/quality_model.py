"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Tokens are words (lower-cased; one in capitals is a word of its own), runs of signs, and a marker
behind a word that is said again at once.  Tokens are hashed into ``WORDS`` words.  Each word has a
sparse index vector of ``DIM`` places, drawn from its number: ``ONES`` of them +1 and as many -1.  A
word's context vector is the sum of the index vectors in windows of ``REACH`` tokens on either side
of its occurrences and of its own, over all documents, brought to length 1.

Context sums are whole numbers in a table of constant size (``WORDS`` x ``DIM``): each task adds up its
own, in ``SLICES`` rows, and two rounds of sums by slice, each streaming over its rows, add up the
tasks', so no task or driver holds more than the table and the order of tasks does not matter.

A document is the mean of its tokens' vectors, over its whole text, and the logarithm of their number.
A network of one hidden layer of ``HIDDEN`` and one output is trained in numpy on a bounded sample of
labelled documents: ``SAMPLE`` rows, least in a hash of the id.  Every fifth of them is held out of
training, and the temperature that divides the output is the one with the least loss on those, so
scores are probabilities.

Defined results: a text that is null, empty or without a token scores the share of label 1 in the
sample; repeated rows get equal scores; other columns pass through and columns named score or
predicted are replaced; labels that are null or neither 0 nor 1 are not learned, a document labelled
both counts once for each; with no label every score is 0.5; with one label only, that share; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

WORDS, DIM, ONES, REACH = 1 << 13, 64, 3, 2
SLICES, BRANCHES = 16, 64
HIDDEN = 24
#: Most labelled documents that are learned from; their pooled vectors (0.26 kB each) reach the driver.
SAMPLE = 12_000
PASSES, BATCH, RATE, DECAY = 60, 256, 0.01, 1e-4
THRESHOLD = 0.3

_SIGNS = ~textvec.NOT_ALNUM  # what separates runs of signs: letters, digits, white space and controls
_SIGNS[:33] = True
_SIGNS[127] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_KINDS = textvec.mix(np.arange(21, 24, dtype=np.uint64))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (words x twice ``ONES``) of the index vectors."""
    order = np.random.default_rng(11).random((WORDS, DIM)).argsort(1)[:, : 2 * ONES]
    return order, np.tile(np.repeat([1, -1], ONES), (WORDS, 1))


_PLACES, _SIGN = index_vectors()
_REPEAT = int(_KINDS[2] >> np.uint64(51))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers of all tokens of some rows in order, and where each row's begin."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends, inside = textvec.runs(data, edge, textvec.NOT_ALNUM)
    length = ends - starts
    low = textvec._LOWER[data]
    words = textvec.finished(textvec.run_hashes(low[inside], *textvec.places(length)), length)
    capitals = np.concatenate(([0], np.cumsum(_CAPITAL[data])))
    shouted = (capitals[ends] - capitals[starts] == length) & (length > 1)
    row = np.searchsorted(offsets, starts, "right") - 1
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) + 1
    words = np.where(shouted, textvec.mix(words ^ _KINDS[0]), words)

    s2, e2, in2 = textvec.runs(data, edge, _SIGNS)
    signs = textvec.mix(textvec.finished(textvec.run_hashes(data[in2], *textvec.places(e2 - s2)), e2 - s2) ^ _KINDS[1])
    # a marker stands right behind its word, before what begins there
    place = np.concatenate((2 * starts, 2 * s2, 2 * ends[again] - 1))
    number = np.concatenate((words >> np.uint64(51), signs >> np.uint64(51), np.full(len(again), _REPEAT, np.uint64))).astype(np.int32)
    order = np.argsort(place, kind="stable")
    return number[order], np.searchsorted(place[order], 2 * offsets)


def contexts(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of index vectors around the words of some rows (words x ``DIM``)."""
    out = np.zeros(WORDS * DIM, np.int64)
    row = textvec.rows_of(first)
    pairs = [np.bincount(number, minlength=WORDS)]
    own = np.arange(WORDS)
    for k in range(2 * ONES):  # its own, once for each occurrence
        out += np.bincount(own * DIM + _PLACES[:, k], weights=pairs[0] * _SIGN[:, k], minlength=WORDS * DIM).astype(np.int64)
    for d in range(1, REACH + 1):
        ok = row[d:] == row[:-d]
        for a, b in ((number[d:][ok], number[:-d][ok]), (number[:-d][ok], number[d:][ok])):
            at = a.astype(np.int64) * DIM
            for half, sign in ((range(ONES), 1), (range(ONES, 2 * ONES), -1)):
                for k in half:
                    out += sign * np.bincount(at + _PLACES[b, k], minlength=WORDS * DIM)
    return out.reshape(WORDS, DIM)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their bytes and offsets."""
    data, offsets = textvec.buffer_of(column)
    for lo, hi in textvec.chunks(offsets):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's context sums, a row for each slice of the table."""
    total = np.zeros((WORDS, DIM), np.int64)
    for batch in batches:
        for _, _, data, offsets in _blocks(batch.column(0)):
            total += contexts(*tokens(data, offsets))
    yield _sliced({k: part for k, part in enumerate(total.reshape(SLICES, -1)) if part.any()})


def _sliced(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts.values()], pa.binary())], ["slice", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's rows by slice."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(sums.as_buffer(), "<i8")
            held[k] = held[k] + own if k in held else own
    yield _sliced(held)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of length 1 (words x ``DIM``) from all texts of ``docs``."""
    schema = "slice int, sums binary"
    own = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_sums, schema)
    some = own.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES))).repartition("slice", "branch").select("slice", "sums").mapInArrow(_added, schema)
    whole = some.repartition("slice").mapInArrow(_added, schema)
    out = np.zeros((SLICES, WORDS * DIM // SLICES))
    for r in whole.toLocalIterator():
        out[r["slice"]] = np.frombuffer(bytes(r["sums"]), "<i8")
    out = out.reshape(WORDS, DIM)
    return (out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1)).astype(np.float32)


def pooled(vectors: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean vector of each row's tokens, and the logarithm of their number and one."""
    n = np.diff(first)
    out = np.zeros((len(n), DIM + 1))
    some = np.flatnonzero(n)
    if len(some):
        out[some, :DIM] = np.add.reduceat(vectors[number], first[some], axis=0, dtype=np.float64) / n[some, None]
    out[:, DIM] = np.log1p(n)
    return out


@dataclass
class Network:
    """Word vectors, the scale of pooled vectors, both layers, the temperature and the share of label 1."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None
    temperature: float
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of pooled vectors; the share of label 1 where there is no token."""
        out = np.full(len(x), self.share)
        some = x[:, DIM] > 0
        if self.layers is not None and some.any():
            out[some] = _sigmoid(output(self.layers, (x[some] - self.mean) / self.scale) / self.temperature)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def output(layers: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Log-odds of label 1."""
    w, b, v, c = layers
    return np.tanh(x @ w + b) @ v + c[0]


def gradients(layers: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean loss."""
    w, b, v, c = layers
    h = np.tanh(x @ w + b)
    d = (_sigmoid(h @ v + c[0]) - y) / len(y)
    back = d[:, None] * v * (1 - h * h)
    return [x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean loss of log-odds."""
    return float(np.mean(np.logaddexp(0, z) - y * z))


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least loss, by golden section over its logarithm."""
    lo, hi, cut = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        if loss(z / np.exp(a), y) <= loss(z / np.exp(b), y):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> Network:
    """The network for pooled vectors and labels, in the order given."""
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(y) else (np.zeros(DIM + 1), np.ones(DIM + 1))
    if share in (0.0, 1.0) or not len(y):
        return Network(vectors, mean, scale, None, 1.0, share)
    rng = np.random.default_rng(5)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or not held.any():
        held[:] = False
    z = (x - mean) / scale
    layers = [rng.normal(0, (DIM + 1) ** -0.5, (DIM + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array([np.log(share / (1 - share))])]
    m, s, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    own, label = z[~held], y[~held]
    for turn in range(PASSES):
        order, rate = rng.permutation(len(own)), RATE * 0.5 * (1 + np.cos(np.pi * turn / PASSES))
        for lo in range(0, len(own), BATCH):
            some = order[lo : lo + BATCH]
            step += 1
            for k, g in enumerate(gradients(tuple(layers), own[some], label[some])):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                layers[k] = layers[k] * (1 - rate * DECAY) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    at = held if held.any() else np.ones(len(y), bool)
    return Network(vectors, mean, scale, tuple(layers), best_temperature(output(tuple(layers), z[at]), y[at]), share)


def _pooler(vectors: np.ndarray) -> Callable:
    """Label, order and the pooled vector of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _blocks(batch.column(2)):
                x = pooled(vectors, *tokens(data, offsets)).astype("<f4")
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "k", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network from the rows of ``labels`` and the texts of ``docs``; word vectors are taken from
    all texts of ``docs``, labelled or not.  The sample of ids is bounded, so it is broadcast, and
    of texts that share an id ``sample`` in all are taken."""
    vectors = word_vectors(docs, text_col)
    own = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("label")).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).distinct().withColumn("k", F.xxhash64(F.lit(17), "_i"))
    chosen = own.orderBy("k", "_i", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_i").select("label", "k", "text")
    found = texts.mapInArrow(_pooler(vectors), "label int, k long, x binary").orderBy("k", "label", "x").limit(sample)
    rows = sorted((r["k"], r["label"], bytes(r["x"])) for r in found.toLocalIterator())
    rows = [r for r in rows if np.frombuffer(r[2], "<f4")[DIM] > 0]  # texts without a token teach nothing
    x = np.array([np.frombuffer(x, "<f4") for _, _, x in rows], np.float64).reshape(len(rows), DIM + 1)
    return fit(x, np.array([y for _, y, _ in rows], np.float64), vectors)


def _scorer(net: Network) -> Callable:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = np.zeros(len(series))
            for lo, hi, data, offsets in _blocks(pa.array(series, pa.large_string(), from_pandas=True)):
                out[lo:hi] = net.score(pooled(net.vectors, *tokens(data, offsets)))
            yield pd.Series(out)

    return run


def score(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with score (0 to 1) and predicted (1 if score >= ``threshold``)."""
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*rest, F.pandas_udf(_scorer(net), "double")(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
