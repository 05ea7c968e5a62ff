"""Hashes and bytes of the files that need them, without contents in a shuffle.

Two places of contents, with one interface: a column of a table, hashed where it lies, and files of
a file system, of which a task opens its own and reads the ranges asked for.  Levels of the funnel
pass ids and hashes on, never contents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..options import Options

#: Most ids that are broadcast to a scan of contents (about 40 bytes each in memory).
BROADCAST_IDS = 1_000_000
#: Bytes that a task reads from files, about, and the size of its reads.
TASK_BYTES, BUFFER = 256 << 20, 1 << 20
#: Ways to hash a file: head and tail, all of it, evenly spread blocks.
PARTIAL, FULL, SAMPLE = "partial", "full", "sample"


class InColumn:
    """Contents in a column of ``files`` (file_id and ``content``).

    Ids asked for are broadcast to the scan while they are few, which is counted first; beyond
    that every row is hashed where it lies and the hashes are joined, so that contents stay where
    they are either way.
    """

    def __init__(self, files: DataFrame, content: str = "content", options: Options | None = None) -> None:
        self.rows = files.select("file_id", F.col(content).alias("content"))
        self.options = options or Options()

    def hashes(self, wanted: DataFrame) -> DataFrame:
        """(file_id, how, hash, size, bytes_read, error) of ``wanted`` (file_id, how)."""
        o, c = self.options, F.col("content")
        ways = {PARTIAL: hashing.partial_hash(c, o.partial_hash_bytes), FULL: hashing.full_hash(c), SAMPLE: hashing.sample_hash(c, o.partial_hash_bytes, o.video_sample_blocks)}
        size = F.length(c).cast("long").alias("size")
        told = lambda rows: rows.select("file_id", "how", "hash", "size", F.col("size").alias("bytes_read"), F.lit(None).cast("string").alias("error"))
        if wanted.count() <= BROADCAST_IDS:
            own = F.lit(None).cast("string")
            for how, value in ways.items():
                own = F.when(F.col("how") == how, value).otherwise(own)
            return told(self.rows.join(F.broadcast(wanted.select("file_id", "how")), "file_id").select("file_id", "how", own.alias("hash"), size))
        asked = [r["how"] for r in wanted.select("how").distinct().collect()]  # three at most
        each = F.explode(F.array(*[F.struct(F.lit(how).alias("how"), ways[how].alias("hash")) for how in asked]))
        every = self.rows.select("file_id", size, each.alias("w")).select("file_id", "size", "w.how", "w.hash")
        return told(every.join(wanted.select("file_id", "how"), ["file_id", "how"]))

    def of(self, ids: DataFrame) -> DataFrame:
        """(file_id, content) of these ids; beyond ``BROADCAST_IDS`` of them contents are shuffled,
        since the rows themselves are asked for."""
        own = ids.select("file_id").distinct()
        return self.rows.join(F.broadcast(own) if own.count() <= BROADCAST_IDS else own, "file_id")


def opened(path: str) -> BinaryIO:
    """A file that can be read and sought: of this machine, or of a store that pyarrow knows by the
    scheme of its address."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", path) and not path.startswith("file://"):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        return store.open_input_file(place)
    return open(re.sub(r"^file:/+", "/", path), "rb", buffering=0)  # noqa: SIM115  closed by the caller


def _read(file: BinaryIO, at: int, count: int) -> bytes:
    """Up to ``count`` bytes from a place, in reads of ``BUFFER`` bytes at most."""
    file.seek(at)
    parts, left = [], count
    while left > 0:
        part = file.read(min(left, BUFFER))
        if not part:
            break
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def _ranges(size: int, how: str, chunk: int, blocks: int) -> list[tuple[int, int]]:
    """The ranges (place, bytes) that a way of hashing reads."""
    if how == FULL or (how == PARTIAL and size <= 2 * chunk) or (how == SAMPLE and size <= chunk * blocks):
        return [(at, min(BUFFER, size - at)) for at in range(0, size, BUFFER)]
    if how == PARTIAL:
        return [(0, chunk), (size - chunk, chunk)]
    return [(math.floor((size - chunk) * i / (blocks - 1)), chunk) for i in range(blocks)]


def hash_file(file: BinaryIO, how: str, chunk: int, blocks: int) -> tuple[str, int, int]:
    """Hash, size and bytes read of an open file; a file that ends early raises."""
    size = file.seek(0, 2)
    size = file.tell() if size is None else size
    total, h = 0, hashlib.md5(f"{size}:".encode() if how == SAMPLE else b"")
    for at, count in _ranges(size, how, chunk, blocks):
        part = _read(file, at, count)
        if len(part) < count:
            raise OSError(f"the file ended at {at + len(part)} of {size} bytes")
        h.update(part)
        total += len(part)
    return h.hexdigest(), size, total


_HASHES = "file_id long, how string, hash string, size long, bytes_read long, error string"


def _hasher(chunk: int, blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, path, how in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    with opened(path) as file:
                        rows.append((file_id, how, *hash_file(file, how, chunk, blocks), None))
                except Exception as error:  # noqa: BLE001  one unreadable file never stops the run
                    rows.append((file_id, how, None, None, None, f"{type(error).__name__}: {error}"[:200]))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file_id", "how", "hash", "size", "bytes_read", "error"])

    return run


def _loader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole contents, a file at a time; null for one that can't be read."""
    for batch in batches:
        for file_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with opened(path) as file:
                    content = file.read()
            except Exception:  # noqa: BLE001  the level that reads it reports the missing content
                content = None
            yield pa.RecordBatch.from_arrays([pa.array([file_id], pa.int64()), pa.array([content], pa.large_binary())], ["file_id", "content"])


class ByPath:
    """Contents of files by their ``path``, or ``uri`` where there is one (``files``: file_id, path, size),
    for places that every executor can open.

    A task seeks to the ranges it needs: two ends, evenly spread blocks, or the whole file in reads
    of ``BUFFER`` bytes, so a file of any size takes a megabyte of memory.  Requests are dealt out
    by the bytes they read.  A file that can't be read has an error and no hash.
    """

    def __init__(self, files: DataFrame, options: Options | None = None) -> None:
        self.files = files.select("file_id", (F.col("uri") if "uri" in files.columns else F.col("path")).alias("path"), "size")
        self.options = options or Options()

    def _dealt(self, asked: DataFrame, cost: str) -> DataFrame:
        told = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(cost)).alias("bytes")).first()
        parts = max(self.files.sparkSession.sparkContext.defaultParallelism, math.ceil((told["bytes"] or 0) / TASK_BYTES))
        return asked.repartition(max(1, min(parts, told["n"])))

    def hashes(self, wanted: DataFrame) -> DataFrame:
        """(file_id, how, hash, size, bytes_read, error) of ``wanted`` (file_id, how)."""
        o = self.options
        asked = self.files.join(wanted.select("file_id", "how"), "file_id").select("file_id", "path", "how", "size")
        cost = f"case how when '{FULL}' then size when '{PARTIAL}' then {2 * o.partial_hash_bytes} else {o.video_sample_blocks * o.partial_hash_bytes} end"
        return self._dealt(asked, cost).select("file_id", "path", "how").mapInArrow(_hasher(o.partial_hash_bytes, o.video_sample_blocks), _HASHES)

    def of(self, ids: DataFrame) -> DataFrame:
        """(file_id, content) of these ids, read in the task that uses them."""
        asked = self.files.join(ids.select("file_id").distinct(), "file_id")
        return self._dealt(asked, "size").select("file_id", "path").mapInArrow(_loader, "file_id long, content binary")
