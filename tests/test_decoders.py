"""PNG and JPEG decoders against pictures that Java's image library has written and read."""

import struct
import zlib

import numpy as np
import pytest

from echofold.functions import imaging
from echofold.plans import pictures
from echofold.sources import decoders, exif, ppm


@pytest.fixture(scope="module")
def java(spark):
    """Writes a picture in a format, and reads one back as (height, width, 3)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    image = jvm.java.awt.image.BufferedImage
    grey = {True: 10, False: 1}  # TYPE_BYTE_GRAY, TYPE_INT_RGB

    def write(rgb, kind, is_grey=False):
        h, w = rgb.shape[:2]
        one = image(w, h, grey[is_grey])
        raster, flat = one.getRaster(), (rgb[..., :1] if is_grey else rgb).ravel().tolist()
        values = gateway.new_array(gateway.jvm.int, len(flat))
        for k, v in enumerate(flat):
            values[k] = v
        raster.setPixels(0, 0, w, h, values)
        out = jvm.java.io.ByteArrayOutputStream()
        assert jvm.javax.imageio.ImageIO.write(one, kind, out)
        return bytes(out.toByteArray())

    def read(content):
        one = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(content))
        w, h = one.getWidth(), one.getHeight()
        flat = np.array(list(one.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
        return np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], -1).astype(np.uint8)

    return write, read


SCENES = [pictures.scene(3, 24, 17), pictures.scene(4, 33, 40, noise=20), np.full((9, 9, 3), 200, np.uint8), np.zeros((1, 1, 3), np.uint8)]


@pytest.mark.parametrize("k", range(len(SCENES)))
def test_png_equals_java(java, k):
    write, _ = java
    content = write(SCENES[k], "png")
    assert (decoders.decode(content) == SCENES[k]).all()
    grey = write(SCENES[k], "png", True)
    assert (decoders.decode(grey) == SCENES[k][..., :1]).all()


@pytest.mark.parametrize("k", range(len(SCENES)))
def test_jpeg_is_close_to_java(java, k):
    write, read = java
    for is_grey in (False, True):
        content = write(SCENES[k], "jpg", is_grey)
        mine, theirs = decoders.decode(content).astype(int), read(content).astype(int)
        assert mine.shape == theirs.shape == SCENES[k].shape
        apart = np.abs(mine - theirs) if not is_grey else np.abs(mine - decoders.decode(content))
        assert apart.mean() < 6  # Java smooths colours between their samples
        if is_grey:
            assert np.abs(mine - SCENES[k][..., :1]).mean() < 8
        else:
            luma = lambda x: x @ np.array([0.299, 0.587, 0.114])
            assert np.abs(luma(mine) - luma(theirs)).mean() < 2


def test_reduced_jpeg(java):
    write, _ = java
    scene = pictures.scene(8, 96, 64)
    content = write(scene, "jpg")
    full = decoders.decode(content).astype(float)
    for side, size in ((10, 1), (20, 2), (40, 4), (90, 8)):
        small, sides = decoders.reduced(content, side)
        assert sides == (96, 64) and small.shape == (8 * size, 12 * size, 3)
        want = full.reshape(8 * size, 8 // size, 12 * size, 8 // size, 3).mean((1, 3))
        assert np.abs(small - want).mean() < 4
    assert decoders.reduced(ppm.encode(scene), 10)[1] == (96, 64)


def encoded(rows, width, height, depth, colour, palette=b"", passes=((0, 0, 1, 1),), kinds=(0, 1, 2, 3, 4)):
    """A PNG written plainly, with filters in turn."""
    count = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    data, step = b"", max(1, depth * count // 8)
    for x, y, dx, dy in passes:
        part = rows[y::dy, x::dx]
        if not part.size:
            continue
        above = bytes((part.shape[1] * depth * count + 7) // 8)
        for n, values in enumerate(part.reshape(part.shape[0], -1)):
            if depth == 16:
                line = b"".join(int(v).to_bytes(2, "big") for v in values)
            else:
                bits = "".join(format(int(v), f"0{depth}b") for v in values)
                line = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            kind, out = kinds[n % len(kinds)], bytearray()
            for i, v in enumerate(line):
                a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - c
                best = min((abs(p - q), k, q) for k, q in enumerate((a, b, c)))[2]
                out.append((v - (0, a, b, (a + b) // 2, best)[kind]) & 255)
            data += bytes([kind]) + bytes(out)
            above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(len(passes) > 1))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("passes", [((0, 0, 1, 1),), decoders._PASSES])
@pytest.mark.parametrize(("depth", "colour"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (1, 3), (2, 3), (4, 3), (8, 3), (8, 4), (16, 4), (8, 6), (16, 6)])
def test_every_kind_of_png(depth, colour, passes):
    rng, count = np.random.default_rng(depth * 10 + colour), {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = rng.integers(0, 1 << depth, (13, 11, count))
    palette = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8) if colour == 3 else None
    got = decoders.decode(encoded(rows, 11, 13, depth, colour, palette.tobytes() if palette is not None else b"", passes))
    eight = rows >> 8 if depth == 16 else rows * 255 // ((1 << depth) - 1)
    want = palette[rows[..., 0]] if colour == 3 else np.repeat(eight[..., :1], 3, 2) if colour in (0, 4) else eight[..., :3]
    assert (got == want).all()


def test_damaged_pictures_raise(java):
    write, _ = java
    for content in (write(SCENES[0], "jpg"), write(SCENES[0], "png")):
        for cut in (*range(0, len(content) - 20, 7), 3):
            try:
                decoders.decode(content[:cut])
            except ValueError:
                continue
            assert content[:2] == b"\xff\xd8"  # a JPEG cut in its last bytes may still be whole
        rng = np.random.default_rng(1)
        for _ in range(60):
            bad = bytearray(content)
            bad[rng.integers(2, len(bad))] ^= 1 << rng.integers(0, 8)
            try:
                assert decoders.decode(bytes(bad)).ndim == 3
            except ValueError:
                pass
    for content in (None, b"", b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"GIF89a"):
        with pytest.raises(ValueError):
            decoders.decode(content)


def test_analysis_of_real_pictures(spark, java):
    """Sides, orientation and hashes of a JPEG with EXIF, its PNG, and a damaged one."""
    write, _ = java
    scene = pictures.scene(5, 80, 56)
    jpeg = write(scene, "jpg")
    turned = exif.write({exif.ORIENTATION: 6, exif.MODEL: "m"}, {}, {}, jpeg=True)
    tagged = turned[:-2] + jpeg[2:] if turned.endswith(b"\xff\xd9") else turned + jpeg[2:]
    files = spark.createDataFrame([(1, jpeg), (2, write(scene, "png")), (3, tagged), (4, jpeg[:200])], "file_id long, content binary")
    got = {r.file_id: r for r in imaging.analyse(files, lambda c: decoders.reduced(c, 32), 32).collect()}
    assert [(got[k].width, got[k].height) for k in (1, 2, 3)] == [(80, 56), (80, 56), (56, 80)] and got[4].error and got[4].width is None
    assert bin((got[1].phash[0] ^ got[2].phash[0]) & (1 << 64) - 1).count("1") <= 8
    assert min(bin((got[3].phash[0] ^ v) & (1 << 64) - 1).count("1") for v in got[1].phash) <= 8 and got[3].camera_key == "m"
