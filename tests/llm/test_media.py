"""Progressive JPEG: exact round trips, and pixels against a plain inverse transform."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from factweave.llm import jpeg, media

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "ÿ\x01\x00é" * 100, "\x01" * 500, "The end.\n" * 3000, "\U0001f600" * 50, "a", "z" * (media.MOST_MCUS * 384 + 70)]


def image(width, height, factors):
    im = jpeg.Image(width, height, [jpeg.Component(i + 1, h, v, 0) for i, (h, v) in enumerate(factors)])
    im.lay_out()
    return im


@pytest.mark.parametrize("seed", range(8))
def test_coefficients_come_back(seed):
    rng = np.random.default_rng(seed)
    shapes = [(64, 64, [(1, 1)]), (33, 17, [(2, 2), (1, 1), (1, 1)]), (8, 8, [(1, 1)]), (100, 20, [(2, 1), (1, 1), (1, 1)]), (1, 1, [(1, 2), (1, 1), (1, 1)])]
    images, coefs = [image(*s) for s in shapes], []
    for im in images:
        c = rng.integers(-300, 300, (im.blocks, 64))
        c[rng.random(c.shape) < rng.random()] = 0
        c[rng.random(c.shape) < 0.1] = rng.choice([1, -1])
        for k in im.components:  # blocks that only fill up an MCU have no AC coefficients
            fill = np.ones((k.high, k.wide), bool)
            fill[: k.down, : k.across] = False
            c[k.first : k.first + k.wide * k.high][fill.ravel(), 1:] = 0
        coefs.append(c)
    files = jpeg.write(coefs, images)
    assert np.array_equal(jpeg.accumulate([jpeg.parse(f) for f in files]), np.concatenate(coefs))
    for f, c in zip(files, coefs):
        assert np.array_equal(jpeg.accumulate([jpeg.parse(f)]), c)


def bits_to_scan(bits):
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    return raw.replace(b"\xff", b"\xff\x00")


def test_end_of_blocks_over_several_blocks():
    """A file without restart markers: one end-of-blocks code covers blocks 1 to 4, in first and refining scans."""
    counts, symbols = [0] * 16, [0x00, 0x01, 0x02, 0x11, 0x20, 0xF0]
    counts[2] = len(symbols)
    codes, lengths = jpeg.code_table(counts, symbols)
    code = lambda s: format(codes[s], f"0{lengths[s]}b")
    table = bytes(counts) + bytes(symbols)
    dc = "".join(code(0) for _ in range(6))
    # Block 0: coefficient 1 is 1, then the end; blocks 1 to 4: one code for 4 blocks (2 + 2 bits); block 5: zero, then -1.
    first = code(0x01) + "1" + code(0x00) + code(0x20) + "00" + code(0x11) + "0" + code(0x00)
    # Refining: block 0 corrects to 3; blocks 1 to 4 covered; block 5: new +1 at coefficient 1, then the correction of -1 to -3.
    refine = code(0x00) + "1" + code(0x20) + "00" + code(0x01) + "1" + code(0x00) + "1"
    frame = bytes([8, 0, 8, 0, 48, 1, 1, 0x11, 0])
    sos = lambda a, b, h: jpeg.segment(jpeg.SOS, bytes([1, 1, 0, a, b, h]))
    data = b"\xff\xd8" + jpeg.segment(jpeg.DQT, b"\0" + b"\2" * 64) + jpeg.segment(jpeg.SOF2, frame)
    data += jpeg.segment(jpeg.DHT, b"\x00" + table) + jpeg.segment(jpeg.DHT, b"\x10" + table)
    data += sos(0, 0, 0) + bits_to_scan(dc) + sos(1, 63, 1) + bits_to_scan(first) + sos(1, 63, 0x10) + bits_to_scan(refine) + b"\xff\xd9"
    got = jpeg.accumulate([jpeg.parse(data)])
    want = np.zeros((6, 64), np.int64)
    want[0, jpeg.ZIGZAG[1]] = 3
    want[5, jpeg.ZIGZAG[1]], want[5, jpeg.ZIGZAG[2]] = 1, -3
    assert np.array_equal(got, want)


def test_pixels_and_chroma():
    rng = np.random.default_rng(1)
    im = image(20, 12, [(2, 2), (1, 1), (1, 1)])
    im.quant = {0: rng.integers(1, 9, 64)}
    coefs = rng.integers(-12, 12, (im.blocks, 64))
    rgb = jpeg.to_rgb(im, coefs)
    assert rgb.shape == (12, 20, 3)

    def sample(component, y, x):
        k = im.components[component]
        block = (coefs[k.first + (y // 8) * k.wide + x // 8] * im.quant[0]).reshape(8, 8)
        scale = lambda u: math.sqrt(0.5) if u == 0 else 1.0
        total = sum(scale(u) * scale(v) / 4 * block[v, u] * math.cos((2 * (x % 8) + 1) * u * math.pi / 16) * math.cos((2 * (y % 8) + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
        return total + 128

    for y, x in [(0, 0), (5, 7), (11, 19), (8, 15)]:
        luma, b, r = sample(0, y, x), sample(1, y // 2, x // 2) - 128, sample(2, y // 2, x // 2) - 128
        want = [luma + 1.402 * r, luma - 0.344136 * b - 0.714136 * r, luma + 1.772 * b]
        assert np.abs(rgb[y, x] - np.clip(want, 0, 255)).max() <= 0.51


def test_media_rows(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string").repartition(3)
    full = {r.doc_id: r for r in media.media_columns(docs).collect()}
    short = {r.doc_id: r for r in media.media_columns(docs, digests=True).collect()}
    assert len(full) == len(short) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        back = b"".join(x for x, _ in media.load([bytes(m) for m in full[i].media]))
        assert back[: len(payload)] == payload and not any(back[len(payload) :])
        r = short[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = b"".join(bytes(m) for m in full[i].media)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), full[i].feature)
    assert len(full[10].media) == 2
    assert full[2][1:] == full[9][1:]
    assert media.media_columns(docs.limit(0)).count() == 0


def test_tensors(spark):
    docs = spark.createDataFrame([(1, "some text " * 50), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in media.tensors(media.media_columns(docs)).collect()}
    assert len(rows[1].rgb) == rows[1].height * rows[1].width * 3 and (rows[2].height, rows[2].width) == (16, 16)
