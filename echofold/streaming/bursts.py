"""Bursts as they arrive: pairs of captures of one camera, from keyed state of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import micros

PAIRS = "a long, b long, delta_us long"


def pairs_of(us: np.ndarray, ids: np.ndarray, fresh: np.ndarray, width: int, neighbours: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of captures in time order, at most ``neighbours`` places and ``width`` apart, of which one
    is fresh."""
    out = []
    for k in range(1, min(neighbours, len(us) - 1) + 1):
        apart = us[k:] - us[:-k]
        ok = (apart <= width) & (fresh[k:] | fresh[:-k])
        out.append((np.minimum(ids[:-k], ids[k:])[ok], np.maximum(ids[:-k], ids[k:])[ok], apart[ok]))
        if not (apart <= width).any():
            break
    return out


def burst_stream(stream: DataFrame, window_seconds: float, neighbours: int = 60, lateness: str = "1 minute", id_col: str = "file_id", time_col: str = "taken_at", camera_col: str = "camera_key") -> DataFrame:
    """(a, b, delta_us) of a stream of captures: pairs of one camera at most ``window_seconds`` apart,
    each as soon as its second capture has arrived.

    The state of a camera holds its captures since the watermark and the ``neighbours`` before it.  A
    capture later than the watermark allows is dropped; one that is late but allowed meets those
    on either side of it.  ``neighbours`` counts the camera's captures known at that time, so for captures
    that arrive in order the pairs are those within ``neighbours`` places of a camera's order.  Captures
    without a time are left out; one that arrives again pairs with itself no more than with others
    of its time.  A camera's state goes when the watermark has left its last capture behind.
    """
    width = int(window_seconds * 1_000_000)
    own = stream.where(F.col(time_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(time_col).cast("timestamp").alias("at"), micros(F.col(time_col)).alias("us"), F.coalesce(F.col(camera_col).cast("string"), F.lit("")).alias("camera"),
    )

    def arrived(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held_us, held_ids = state.get if state.exists else ([], [])
        held = set(zip(held_us, held_ids, strict=True))
        new = sorted({(int(u), int(i)) for f in frames for u, i in zip(f["us"], f["id"], strict=True)} - held)
        us = np.array([*held_us, *(u for u, _ in new)], np.int64)
        ids = np.array([*held_ids, *(i for _, i in new)], np.int64)
        fresh = np.arange(len(us)) >= len(held_us)
        order = np.lexsort((ids, us))
        us, ids, fresh = us[order], ids[order], fresh[order]
        for a, b, apart in pairs_of(us, ids, fresh, width, neighbours):
            ok = a != b
            if ok.any():
                yield pd.DataFrame({"a": a[ok], "b": b[ok], "delta_us": apart[ok]})
        mark = state.getCurrentWatermarkMs()
        first = max(0, int(np.searchsorted(us, mark * 1000)) - neighbours)
        state.update((us[first:].tolist(), ids[first:].tolist()))
        if len(us):
            state.setTimeoutTimestamp(max(int(us[-1]) // 1000 + width // 1000, mark) + 1)

    return own.withWatermark("at", lateness).groupBy("camera").applyInPandasWithState(arrived, PAIRS, "us array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
