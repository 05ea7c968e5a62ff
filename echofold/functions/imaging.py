"""Image numerics in numpy, and their Arrow-batched forms.

Hashes are 64-bit patterns in signed longs.  A picture is row-major; grids are float64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import contents_in_batches

SIDE, LOW = 32, 8


def luma(rgb: np.ndarray) -> np.ndarray:
    """Rec. 601 brightness of (height, width, 3) bytes."""
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


@lru_cache(maxsize=256)
def _shares(source: int, target: int) -> np.ndarray:
    """Weights (target x source) of a box filter with fractional overlap."""
    edges = np.arange(target + 1) * source / target
    lo, hi = edges[:-1, None], edges[1:, None]
    cell = np.arange(source)[None, :]
    overlap = np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None)
    return overlap / overlap.sum(1, keepdims=True)


def resize_area(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area-averaged resize, as one product per direction."""
    return _shares(grid.shape[0], height) @ grid @ _shares(grid.shape[1], width).T


_COS = np.cos((2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] * np.pi / (2 * SIDE))


def _bits(flags: np.ndarray) -> int:
    """A signed long whose bit i is flag i."""
    return int.from_bytes(np.packbits(flags.ravel(), bitorder="little").tobytes(), "little", signed=True)


def coefficients(grid: np.ndarray) -> np.ndarray:
    """The low 8 x 8 of the cosine transform (rows v, columns u), rounded so that other engines
    agree about values at the median."""
    return np.round(_COS @ grid @ _COS.T, 6)


def hash_of(c: np.ndarray) -> int:
    """Bit v * 8 + u is set where the coefficient is above the median."""
    return _bits(c > np.median(c))


_SIGN = np.where(np.arange(LOW) % 2, -1.0, 1.0)


def variants(grid: np.ndarray) -> list[int]:
    """Hashes of the eight orientations (bit 0 mirrors x, bit 1 mirrors y, bit 2 transposes).

    Mirroring flips the sign of odd coefficients and transposing swaps them, so one transform of
    the picture serves all eight.
    """
    c, out = coefficients(grid), []
    for k in range(8):
        t = c.T if k & 4 else c
        t = t * _SIGN[None, :] if k & 1 else t
        out.append(hash_of(t * _SIGN[:, None] if k & 2 else t))
    return out


def phash_variants(grid: np.ndarray) -> list[int]:
    return variants(resize_area(grid, SIDE, SIDE))


def dhash(grid: np.ndarray) -> int:
    s = resize_area(grid, 9, 8)
    return _bits(s[:, :-1] < s[:, 1:])


def sharpness(grid: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; 0 for less than three pixels a side."""
    if min(grid.shape) < 3:
        return 0.0
    c = grid[1:-1, 1:-1]
    return float(np.var(4 * c - grid[1:-1, :-2] - grid[1:-1, 2:] - grid[:-2, 1:-1] - grid[2:, 1:-1]))


def preprocess(rgb: np.ndarray, side: int, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Centre crop, bilinear resize and channel normalisation (channels first) for a model."""
    h, w = rgb.shape[:2]
    n = min(h, w)
    crop = rgb[(h - n) // 2 : (h - n) // 2 + n, (w - n) // 2 : (w - n) // 2 + n].astype(np.float64) / 255
    at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    lo, part = np.floor(at).astype(int), at - np.floor(at)
    hi = np.minimum(lo + 1, n - 1)
    rows = crop[lo] * (1 - part)[:, None, None] + crop[hi] * part[:, None, None]
    out = rows[:, lo] * (1 - part)[None, :, None] + rows[:, hi] * part[None, :, None]
    return ((out - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def text_cells(text: Column) -> Column:
    """The cells of a text's picture: of each distinct two-word shingle one of ``SIDE`` x ``SIDE``, by
    its md5."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\S+)"), 1)
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, i: F.concat(F.get(w, i), F.lit(" "), b))
    cell = lambda s: (F.conv(F.substring(F.md5(s), 1, 6), 16, 10).cast("int") % (SIDE * SIDE)).cast("int")
    # the words are bound once a row; named twice they would be found again for every pair
    return F.element_at(F.transform(F.array(words), lambda w: F.transform(F.array_distinct(pairs(w)), cell)), 1)


def many_variants(grids: np.ndarray) -> np.ndarray:
    """``variants`` of many pictures (pictures x SIDE x SIDE) at once."""
    c, out = np.round(_COS @ grids @ _COS.T, 6), []
    for k in range(8):
        t = c.transpose(0, 2, 1) if k & 4 else c
        t = t * _SIGN[None, None, :] if k & 1 else t
        t = (t * _SIGN[None, :, None] if k & 2 else t).reshape(len(c), -1)
        bits = t > np.median(t, axis=1, keepdims=True)
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0])
    return np.stack(out, 1)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phash array<bigint>) of the texts' pictures: cells in Spark, transforms in batches."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cells = part.column(1)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
                flat = pc.list_flatten(cells).to_numpy(zero_copy_only=False).astype(np.int64)
                grids = np.bincount(row * SIDE * SIDE + flat, minlength=part.num_rows * SIDE * SIDE).reshape(-1, SIDE, SIDE).astype(float)
                hashes = many_variants(grids)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * 8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(hashes.ravel()))], [id_col, "phash"])

    return docs.select(id_col, text_cells(F.col(text_col)).alias("cells")).mapInArrow(run, f"{id_col} {kind}, phash array<bigint>")


def oriented(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """A picture turned upright by its EXIF orientation (1 to 8)."""
    if orientation >= 5:
        rgb = rgb.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        rgb = rgb[:, ::-1]
    return rgb[::-1] if orientation in (3, 4, 7, 8) else rgb


def upright_size(width: int, height: int, seen_width: int, seen_height: int) -> tuple[int, int]:
    """Sides of a file as its upright picture has them: swapped where the shapes disagree."""
    return (height, width) if width != height and (width > height) != (seen_width > seen_height) else (width, height)


def thumbnail(rgb: np.ndarray, side: int) -> np.ndarray:
    """Brightness of a picture, shrunk to ``side`` at most."""
    grid, (h, w) = luma(rgb), rgb.shape[:2]
    if max(h, w) > side:
        grid = resize_area(grid, max(1, round(w * side / max(h, w))), max(1, round(h * side / max(h, w))))
    return grid


def analyse(files: DataFrame, decode, thumbnail_side: int = 256) -> DataFrame:
    """(file_id, width, height, phash, dhash, sharpness, error, and the fields of EXIF but make,
    model and orientation, with camera_key) of files with ``content`` bytes.  ``decode`` turns bytes
    into (height, width, 3), or into a smaller picture and the full (width, height), or raises; an error is a row with its text, so one bad file never stops
    the run."""
    from ..sources import exif

    columns = ["file_id", "width", "height", "phash", "dhash", "sharpness", "error", "taken_at", "camera_key", "latitude", "longitude", "richness"]

    def one(content: bytes) -> tuple:
        meta, rgb = exif.read(content), decode(content)
        rgb, (width, height) = rgb if isinstance(rgb, tuple) else (rgb, (rgb.shape[1], rgb.shape[0]))
        seen = oriented(rgb, meta["orientation"])
        w, h = upright_size(width, height, seen.shape[1], seen.shape[0])
        grid = thumbnail(seen, thumbnail_side)
        camera = f"{meta['make'] or ''}|{meta['model'] or ''}".strip("|")
        return w, h, phash_variants(grid), dhash(grid), sharpness(grid), None, meta["taken_at"], camera, meta["latitude"], meta["longitude"], meta["richness"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file_id, content in zip(f["file_id"], f["content"], strict=True):
                try:
                    rows.append((file_id, *one(content)))
                except Exception as error:  # noqa: BLE001  any decoder error marks its file
                    rows.append((file_id, *[None] * 5, str(error)[:200], *[None] * 5))
            kinds = {"width": "Int32", "height": "Int32", "dhash": "Int64", "richness": "Int32", "taken_at": "datetime64[us]", "latitude": "float64", "longitude": "float64", "sharpness": "float64"}
            yield pd.DataFrame(rows, columns=columns).astype(kinds)

    schema = "file_id long, width int, height int, phash array<bigint>, dhash bigint, sharpness double, error string, taken_at timestamp_ntz, camera_key string, latitude double, longitude double, richness int"
    return contents_in_batches(files.select("file_id", "content")).mapInPandas(run, schema)


def pixel_hashes(files: DataFrame, decode) -> DataFrame:
    """(file_id, pixel_hash) of the sides and pixels at full size; null where decoding fails."""

    def hashed(content: bytes) -> str | None:
        try:
            rgb = decode(content)
        except Exception:  # noqa: BLE001  without a pixel hash the file counts as perceptual
            return None
        return hashlib.md5(rgb.shape[1].to_bytes(4, "little") + rgb.shape[0].to_bytes(4, "little") + rgb.tobytes()).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"file_id": f["file_id"], "pixel_hash": [hashed(c) for c in f["content"]]})

    return contents_in_batches(files.select("file_id", "content")).mapInPandas(run, "file_id long, pixel_hash string")


#: Pictures on which a network fails in a row, with none in between that it takes, before it is not
#: asked again in a task.
GIVE_UP = 8


def isolated(embed, inputs: np.ndarray) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Vectors and errors of a batch: a batch that fails is halved until what fails is alone.  A vector
    that is not finite counts as failed."""
    try:
        v = np.asarray(embed(inputs), float)
        if v.ndim != 2 or len(v) != len(inputs):
            raise ValueError(f"{len(inputs)} pictures gave vectors of shape {v.shape}")  # noqa: TRY301
        bad = ~np.isfinite(v).all(1)
        return [None if b else x for x, b in zip(v, bad, strict=True)], ["not finite" if b else None for b in bad]
    except Exception as error:  # noqa: BLE001  a picture or network that fails stops vectors, not the run
        if len(inputs) == 1:
            return [None], [f"{type(error).__name__}: {error}"[:200]]
    half = len(inputs) // 2
    (v, e), (w, f) = isolated(embed, inputs[:half]), isolated(embed, inputs[half:])
    return v + w, e + f


def embeddings(files: DataFrame, decode, embed, side: int = 224, batch: int = 8, with_errors: bool = False) -> DataFrame:
    """(file_id, embedding) by a given network: ``embed`` maps (pictures, 3, side, side) to vectors,
    which are brought to unit length.  A picture that can't be decoded or that the network fails on
    has none, and the others of its batch have theirs.  A network that fails on ``GIVE_UP`` pictures in
    a row is not asked again in that task: vectors stop, the run does not.  ``with_errors`` adds
    vector_error and a row for each picture without a vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for f in frames:
            for lo in range(0, len(f), batch):
                ids, inputs, rows = [], [], []
                for file_id, content in zip(f["file_id"][lo : lo + batch], f["content"][lo : lo + batch], strict=True):
                    try:
                        inputs.append(preprocess(decode(content), side))
                        ids.append(file_id)
                    except Exception as error:  # noqa: BLE001
                        rows.append((file_id, None, f"{type(error).__name__}: {error}"[:200]))
                if ids and failed >= GIVE_UP:
                    rows += [(i, None, "the network failed before") for i in ids]
                elif ids:
                    for file_id, v, error in zip(ids, *isolated(embed, np.stack(inputs)), strict=True):
                        failed = failed + 1 if v is None else 0
                        rows.append((file_id, None if v is None else (v / max(np.linalg.norm(v), 1e-12)).tolist(), error))
                kept = rows if with_errors else [r for r in rows if r[1] is not None]
                if kept:
                    yield pd.DataFrame([r if with_errors else r[:2] for r in kept], columns=["file_id", "embedding", "vector_error"][: 3 if with_errors else 2])

    return contents_in_batches(files.select("file_id", "content")).mapInPandas(run, "file_id long, embedding array<double>" + (", vector_error string" if with_errors else ""))
