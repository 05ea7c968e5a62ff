"""Decoders of PNG and baseline JPEG in numpy, and one that picks the decoder by the first bytes.

``decode`` gives (height, width, 3) bytes at full size; ``reduced`` gives a JPEG at an eighth, a quarter or
half of its sides, whichever is the least not below a wanted side, from the low coefficients of each
block only.  Content that is damaged or of another kind raises, which the caller turns into a row
with an error.  Alpha is ignored, 16 bits a sample are read as 8.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

from . import ppm

#: Most pixels of a picture that is decoded.
MOST = 1 << 28


class Damaged(ValueError):
    """The content is no picture that can be decoded."""


# --- PNG -------------------------------------------------------------------------------------

_PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the standard: samples of a pixel by colour type, and starts and steps of the
#: passes of an interlaced picture (x, y, step of x, step of y).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without their filters (``kinds``, one a row); ``step`` is the bytes of a pixel.

    A pixel needs its left, upper and upper-left neighbours only, so all pixels on a diagonal are
    done at a time, whatever the filters of their rows.
    """
    h, n = rows.shape[0], rows.shape[1] // step
    x = rows.reshape(h, n, step)
    out = np.zeros((h + 1, n + 1, step), np.int16)  # a row above and a column before, of zeros
    sub, up, average, paeth = ((kinds == k)[:, None] for k in (1, 2, 3, 4))
    for t in range(h + n - 1):
        y = np.arange(max(0, t - n + 1), min(h, t + 1))
        k = t - y
        a, b, c = out[y + 1, k], out[y, k + 1], out[y, k]
        p = a + b - c
        pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        add = np.where(sub[y], a, 0) + np.where(up[y], b, 0) + np.where(average[y], (a + b) >> 1, 0) + np.where(paeth[y], nearest, 0)
        out[y + 1, k + 1] = (x[y, k] + add) & 255
    return out[1:, 1:].reshape(h, n * step).astype(np.uint8)


def _samples(data: bytes, at: int, width: int, height: int, depth: int, count: int) -> tuple[np.ndarray, int]:
    """Samples (height, width, count) of one pass, and where the next begins."""
    line = (width * depth * count + 7) // 8
    need = height * (line + 1)
    raw = np.frombuffer(data, np.uint8, need, at).reshape(height, line + 1)
    if (raw[:, 0] > 4).any():
        raise Damaged("unknown filter")
    rows = unfilter(raw[:, 0], raw[:, 1:], max(1, depth * count // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1)).sum(2).astype(np.uint8)
    return rows[:, : width * count].reshape(height, width, count), at + need


def decode_png(content: bytes) -> np.ndarray:
    """A PNG of any colour type, depth and interlacing."""
    if content[:8] != _PNG:
        raise Damaged("not a PNG")
    at, head, palette, parts = 8, None, None, []
    while at + 12 <= len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            raise Damaged("damaged chunk")
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or len(head) != 13 or not parts:
        raise Damaged("no header or no data")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, interlaced = head[8], head[9], head[12]
    if colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16) or not 0 < width * height <= MOST:
        raise Damaged("unknown kind of picture")
    count = _SAMPLES[colour]
    passes = _PASSES if interlaced else ((0, 0, 1, 1),)
    sides = [(max(0, -(-(width - x) // dx)), max(0, -(-(height - y) // dy))) for x, y, dx, dy in passes]
    room = sum(h * ((w * depth * count + 7) // 8 + 1) for w, h in sides if w and h)
    try:
        data = zlib.decompressobj().decompress(b"".join(parts), room)
    except zlib.error as error:
        raise Damaged(str(error)) from None
    if len(data) < room:
        raise Damaged("too little data")
    out, at = np.zeros((height, width, count), np.uint8), 0
    for (x, y, dx, dy), (w, h) in zip(passes, sides, strict=True):
        if w and h:
            out[y::dy, x::dx], at = _samples(data, at, w, h, depth, count)
    if colour == 3:
        if palette is None or int(out.max()) >= len(palette):
            raise Damaged("colour beyond the palette")
        return palette[out[:, :, 0]]
    if depth < 8:
        out = (out.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(out[:, :, :1], 3, 2) if colour in (0, 4) else out[:, :, :3]


# --- JPEG ------------------------------------------------------------------------------------


@cache
def zigzag() -> tuple[int, ...]:
    """Places (8 * row + column) of the coefficients in the order they are stored: along diagonals,
    turning at the edges."""
    places = [(r, c) for r in range(8) for c in range(8)]
    return tuple(8 * r + c for r, c in sorted(places, key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1])))


@cache
def basis(size: int) -> np.ndarray:
    """Inverse transform (size x size) from the first ``size`` of eight coefficients."""
    u, x = np.arange(size), np.arange(size)
    scale = np.where(u == 0, np.sqrt(0.5), 1.0)
    return (np.cos((2 * x[:, None] + 1) * u[None, :] * np.pi / (2 * size)) * scale * np.sqrt(2 / size)) * np.sqrt(size / 8)


class _Bits:
    """Bits of the entropy-coded data of one restart interval."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.hold, self.have = data, 0, 0, 0

    def fill(self, count: int) -> None:
        while self.have < count:
            take = self.data[self.at : self.at + 6]
            self.at += 6
            if not take:
                if self.at > len(self.data) + 64:
                    raise Damaged("the data end too early")
                take = b"\0" * 6
            self.hold = ((self.hold & ((1 << self.have) - 1)) << (8 * len(take))) | int.from_bytes(take, "big")
            self.have += 8 * len(take)

    def symbol(self, table: list[int]) -> int:
        """The next symbol by a table over 16 bits of (length << 8 | symbol)."""
        if self.have < 16:
            self.fill(16)
        found = table[(self.hold >> (self.have - 16)) & 0xFFFF]
        if not found:
            raise Damaged("unknown code")
        self.have -= found >> 8
        return found & 255

    def number(self, size: int) -> int:
        """A signed number of ``size`` bits."""
        if not size:
            return 0
        if self.have < size:
            self.fill(size)
        self.have -= size
        v = (self.hold >> self.have) & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """A Huffman table over all 16 bits."""
    table, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            lo = code << (16 - length)
            if lo + (1 << (16 - length)) > 65536:
                raise Damaged("codes beyond their length")
            table[lo : lo + (1 << (16 - length))] = [length << 8 | s] * (1 << (16 - length))
            code += 1
        at, code = at + n, code << 1
    return table


class _Jpeg:
    """The segments of a JPEG, and its coefficients."""

    def __init__(self, content: bytes) -> None:
        if content[:2] != b"\xff\xd8":
            raise Damaged("not a JPEG")
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, list[int]] = {}
        self.parts: list[list[int]] = []  # id, horizontal and vertical samples, quantisation
        self.restart, self.colours, at = 0, None, 2
        while True:
            if at + 4 > len(content):
                raise Damaged("no scan")
            if content[at] != 0xFF:
                raise Damaged("no marker")
            kind = content[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            body = content[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                self._quantisation(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind in (0xC0, 0xC1):
                if len(body) < 6 or body[0] != 8:
                    raise Damaged("unknown precision")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]] for k in range(body[5])]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise Damaged("only baseline pictures are decoded")
            elif kind == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.colours = body[11]
            elif kind == 0xDA:
                break
        if not self.parts or not 0 < self.width * self.height <= MOST or any(not 1 <= p[1] <= 4 or not 1 <= p[2] <= 4 for p in self.parts):
            raise Damaged("no frame before the scan")
        if body[0] != len(self.parts):
            raise Damaged("only pictures of one scan are decoded")
        tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
        self._coefficients([tables[p[0]] for p in self.parts], content[at:])

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide = body[at] >> 4
            values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int32)
            table = np.zeros(64, np.int32)
            table[list(zigzag())] = values
            self.quant[body[at] & 15] = table
            at += 1 + 64 * (1 + bool(wide))

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            self.codes[body[at]] = _codes(counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)

    def _coefficients(self, tables: list[int], data: bytes) -> None:
        """The blocks of all components, in rows of blocks that cover whole units."""
        across, down = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:  # a single component is not interleaved
            self.parts[0][1:3], across, down = [1, 1], 1, 1
        units_x, units_y = -(-self.width // (8 * across)), -(-self.height // (8 * down))
        self.blocks = [np.zeros((units_y * p[2], units_x * p[1], 64), np.int32) for p in self.parts]
        end = data.rfind(b"\xff\xd9")
        intervals, lo, at = [], 0, data.find(b"\xff")
        data = data[: end if end >= 0 else len(data)]
        while 0 <= at < len(data) - 1:
            if 0xD0 <= data[at + 1] <= 0xD7:
                intervals.append(data[lo:at])
                lo = at + 2
            at = data.find(b"\xff", at + 2 if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7 else at + 1)
        intervals = [x.replace(b"\xff\x00", b"\xff") for x in (*intervals, data[lo:])]
        order, total = zigzag(), units_x * units_y
        each = self.restart or total
        try:
            plan = [(k, p[1], p[2], self.codes[t >> 4], self.codes[16 + (t & 15)]) for k, (p, t) in enumerate(zip(self.parts, tables, strict=True))]
        except KeyError:
            raise Damaged("no table for a component") from None
        if len(intervals) < -(-total // each):
            raise Damaged("intervals are missing")
        for n in range(-(-total // each)):
            bits, last = _Bits(intervals[n]), [0] * len(plan)
            for unit in range(n * each, min(total, (n + 1) * each)):
                uy, ux = divmod(unit, units_x)
                for k, wide, high, dc, ac in plan:
                    for v in range(high):
                        for h in range(wide):
                            block = self.blocks[k][uy * high + v, ux * wide + h]
                            last[k] += bits.number(bits.symbol(dc))
                            block[0] = last[k]
                            at = 1
                            while at < 64:
                                s = bits.symbol(ac)
                                run, size = s >> 4, s & 15
                                if size:
                                    at += run
                                    if at > 63:
                                        raise Damaged("coefficients beyond their block")
                                    block[order[at]] = bits.number(size)
                                    at += 1
                                elif run == 15:
                                    at += 16
                                else:
                                    break

    def pixels(self, size: int) -> np.ndarray:
        """(height, width, 3) with ``size`` of eight pixels along the side of a block."""
        planes, across, down = [], max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        height, width = -(-self.height * size // 8), -(-self.width * size // 8)
        for blocks, (_, h, v, q) in zip(self.blocks, self.parts, strict=True):
            if q not in self.quant:
                raise Damaged("no quantisation table")
            tall, wide = size * down // v, size * across // h  # pixels that a block covers
            sy, sx = min(8, tall), min(8, wide)
            low = (blocks * self.quant[q]).reshape(*blocks.shape[:2], 8, 8)[:, :, :sy, :sx].astype(np.float64)
            tiles = np.einsum("yu,abuv,xv->aybx", basis(sy), low, basis(sx), optimize=True)
            plane = tiles.reshape(blocks.shape[0] * sy, blocks.shape[1] * sx) + 128
            planes.append(np.repeat(np.repeat(plane, tall // sy, 0), wide // sx, 1)[:height, :width])
        if len(planes) == 1:
            planes *= 3
        elif len(planes) == 3 and self.colours != 0:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        elif len(planes) != 3:
            raise Damaged("unknown colours")
        return np.clip(np.rint(np.stack(planes, -1)), 0, 255).astype(np.uint8)


def decode_jpeg(content: bytes) -> np.ndarray:
    """A baseline JPEG at full size."""
    try:
        return _Jpeg(content).pixels(8)
    except (IndexError, KeyError) as error:
        raise Damaged(f"damaged segment: {error}") from None


def reduced(content: bytes, side: int) -> tuple[np.ndarray, tuple[int, int]]:
    """A picture whose longer side is ``side`` or more, as small as the format gives it at once, and its
    full sides (width, height)."""
    if content[:2] != b"\xff\xd8":
        rgb = decode(content)
        return rgb, (rgb.shape[1], rgb.shape[0])
    try:
        own = _Jpeg(content)
        size = next((s for s in (1, 2, 4) if max(own.width, own.height) * s // 8 >= side), 8)
        return own.pixels(size), (own.width, own.height)
    except (IndexError, KeyError) as error:
        raise Damaged(f"damaged segment: {error}") from None


def decode(content: bytes) -> np.ndarray:
    """A PNG, baseline JPEG or P6 picture at full size."""
    if content is None:
        raise Damaged("no content")
    if content[:8] == _PNG:
        return decode_png(content)
    if content[:2] == b"\xff\xd8":
        return decode_jpeg(content)
    return ppm.decode(content)
