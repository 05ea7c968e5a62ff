"""Packing by power-of-two decomposition.

A document of n token ids is cut into pieces whose lengths are the powers of two of n's binary
form (as many pieces of ``max_len`` as fit, then one for each set bit, longest first).  Each
piece is one sequence: pieces of equal length share a bucket, so batches need no padding and no
sequence crosses documents.

The plan is one scan and one Arrow map: no shuffle, memory bounded by a batch, and a lost
executor costs its running tasks only.

Ids are those of the ``tokenizers`` file, special tokens of its own in a text included: such a
token's string becomes its id.  Texts are encoded in parts at which its pattern always splits; a
worker remembers the ids of parts, since most come again; a part is known again by a hash and then
by its bytes.

Defined results: null text counts as empty; an empty text is one piece of one id (the end id);
repeated rows and equal or null doc_ids are packed each on its own; other columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec

END_ID = 1
MAX_LEN = 2048
#: Encoded parts that a worker remembers, about 60 bytes each; the memory is cleared beyond it (a
#: speed matter only).  Newer ones are kept apart and merged into the others ``RECENT`` at a time.
REMEMBER, RECENT = 2_500_000, 1 << 18


_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
_SIGN = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])


def vocabulary() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def part_starts(data: np.ndarray, offsets: np.ndarray, special: Sequence[bytes] = ()) -> np.ndarray:
    """Places where the vocabulary always splits: the starts of rows, both ends of a special token,
    white space in ASCII after a character that is not white space, and a sign in ASCII after a
    letter in ASCII.

    No token of the pattern goes on from a visible character into white space or from a letter into a
    sign, and its only look-ahead is within a run of white space, so encoding the parts alone gives the
    same ids.  A place after a character that may be white space beyond ASCII is left out, and so
    are places inside a special token.
    """
    white = textvec.WHITE[data] | ((data >= 0x1C) & (data <= 0x1F))
    wide = np.zeros(len(data), bool)  # last byte of a character that may be wide white space
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        wide[1:] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        lead = ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        wide[2:] |= lead[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (white[1:] & ~white[:-1] & ~wide[:-1]) | (_SIGN[data[1:]] & _LETTER[data[:-1]])
    raw = data.tobytes() if special else b""
    found = [m.span(1) for t in special if t in raw for m in re.finditer(b"(?=(" + re.escape(t) + b"))", raw)]
    for lo, hi in found:
        if np.searchsorted(offsets, lo, "right") == np.searchsorted(offsets, hi, "left"):  # in one row
            cut[lo + 1 : hi] = False
            cut[lo] = cut[hi] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids of whole texts, with a memory of parts: found by a hash, and compared byte by byte."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.longest = max(map(len, self.special), default=0)
        self.clear()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.older, self.newer = none, none  # keys in order, and the numbers of their parts
        self.parts = 0
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1 << 16, np.int64)  # at[k], at[k + 1]: where the ids of part k are
        self.bytes = np.zeros(1 << 20, np.uint8)
        self.bytes_at = np.zeros(1 << 16, np.int64)  # likewise its bytes

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the parts with these keys, -1 for new ones."""
        out = np.full(len(keys), -1, np.int64)
        for have, number in (self.older, self.newer):
            if len(have):
                place = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[place] == keys
                out[hit] = number[place[hit]]
        return out

    @staticmethod
    def _merged(table: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(table[0], more[0])
        return np.insert(table[0], place, more[0]), np.insert(table[1], place, more[1])

    @staticmethod
    def _stored(store: np.ndarray, at: np.ndarray, parts: int, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both arrays with the values of further parts, grown to twice their size where full."""
        ends = at[parts] + np.cumsum(counts)
        while parts + len(counts) + 1 > len(at):
            at = np.concatenate((at, np.zeros(len(at), at.dtype)))
        while ends[-1] > len(store):
            store = np.concatenate((store, np.zeros(len(store), store.dtype)))
        store[at[parts] : ends[-1]] = flat
        at[parts + 1 : parts + 1 + len(counts)] = ends
        return store, at

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes these parts and stores their ids and bytes; their numbers."""
        whole = data.tobytes()
        raw = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = self.encode([x.decode("utf-8", "replace") for x in raw])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        self.ids, self.at = self._stored(self.ids, self.at, self.parts, flat, counts)
        self.bytes, self.bytes_at = self._stored(self.bytes, self.bytes_at, self.parts, np.frombuffer(b"".join(raw), np.uint8), ends - starts)
        self.parts += len(found)
        return np.arange(self.parts - len(found), self.parts, dtype=np.int32)

    def _remember(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.newer = self._merged(self.newer, (keys, numbers))
        if len(self.newer[0]) > RECENT:
            self.older = self._merged(self.older, self.newer)
            self.newer = (self.newer[0][:0], self.newer[1][:0])

    def _unlike(self, part: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which parts of ``data``, that lie on end, differ from the stored ones of these numbers."""
        size, begin = ends - starts, self.bytes_at[part]
        differ = self.bytes_at[part + 1] - begin != size
        begin = np.where(differ, 0, begin)  # any place: these differ already
        at = np.arange(len(data)) + np.repeat(begin - starts, size)
        wrong = np.flatnonzero(self.bytes.take(at, mode="clip") != data)
        differ[np.searchsorted(starts, wrong, "right") - 1] = True
        return np.flatnonzero(differ)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows in order, and where each row's ids begin (one more entry)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.parts > REMEMBER:
            self.clear()
        starts = part_starts(data, offsets, self.special)
        ends = np.append(starts[1:], len(data))
        keys = textvec.finished(textvec.run_hashes(data, *textvec.places(ends - starts)), ends - starts)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        known = self._find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self._encoded(data, starts[where[new]], ends[where[new]])
            self._remember(distinct[new], known[new].astype(np.int32))
        part = known[back]
        other = self._unlike(part, data, starts, ends)  # parts that share another one's hash
        if len(other):
            part[other] = self._encoded(data, starts[other], ends[other])
        begin, count = self.at[part], self.at[part + 1] - self.at[part]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)]
        return ids, total[np.searchsorted(starts, offsets)]

    def whole(self, data: np.ndarray) -> np.ndarray:
        """All ids of one long text, a block of parts at a time."""
        out, lo, size = [], 0, textvec.CHUNK
        while lo < len(data):
            block = data[lo : lo + size]
            hi = len(block)
            if lo + hi < len(data):
                starts = part_starts(block, np.array([0, len(block)]), self.special)
                hi = int(starts[np.searchsorted(starts, max(len(block) - self.longest, 0), "right") - 1])  # no special token lies across
                if not hi:  # one part fills the block
                    size *= 2
                    continue
            out.append(self.batch(block[:hi], np.array([0, hi]))[0])
            lo, size = lo + hi, textvec.CHUNK
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Piece lengths of n ids: whole ``max_len`` pieces, then the set bits of the rest."""
    out = [max_len] * (n // max_len)
    rest, bit = n % max_len, max_len >> 1
    while rest:
        if rest & bit:
            out.append(bit)
            rest ^= bit
        bit >>= 1
    return out


_encoders: dict[str, Encoder] = {}


def _packer(path: str, max_len: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            data, offsets = textvec.buffer_of(batch.column(2))
            for lo, hi in textvec.chunks(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                if len(part) > 2 * textvec.CHUNK:  # one long text
                    ids = encoder.whole(part)
                    first = np.array([0, len(ids)])
                else:
                    ids, first = encoder.batch(part, off)
                rows, start, length, crc, whole, out = [], [], [], [], [], []
                for r in range(hi - lo):
                    own = np.append(ids[first[r] : first[r + 1]], END_ID).astype("<u4")
                    at = 0
                    for n in binary_lengths(len(own), max_len):
                        piece = own[at : at + n]
                        rows.append(lo + r)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        whole.append(len(own))
                        if with_ids:
                            out.append(piece)
                        at += n
                columns = [*(batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole))]
                names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
                    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, with_ids: bool = True, vocabulary_at: str | None = None) -> DataFrame:
    """One row per piece: row (a number of the packed row: copies of a document have their own),
    doc_id, start, length, ids_crc32, doc_tokens, ids (if asked for), bucket (log2 of the length),
    sequence_id and offset (0: a piece is a sequence).

    ``max_len`` must be a power of two.  ``sequence_id`` numbers the pieces by partition, so no
    global sort is needed; it is the same on a rerun over the same files.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["row"], slim.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    pieces = slim.mapInArrow(_packer(vocabulary_at or vocabulary(), max_len, with_ids), schema)
    bucket = F.log2(F.col("length")).cast("int")
    return pieces.withColumns({"bucket": bucket, "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
