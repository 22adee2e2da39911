"""Media columns of progressive JPEGs.

A payload is stored losslessly as the quantised coefficients of colour images
with halved chroma: 64 bytes are the 64 coefficients of a block (the format's
unit), and quantisers are 1. Reading accumulates the scans, gives the
coefficients back, and makes full-resolution RGB tensors of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import small_batches, table

UNIT = 64
#: An image is one row of MCUs, each of four luma blocks and two of chroma; longer payloads take several images.
BLOCKS_IN_MCU = 6
MOST_MCUS = 2048
#: Payload bytes that are worked on together.
SLICE = 1 << 20


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled with zeros to a positive multiple of 64, and their number without these."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0"), len(data)


def blank_image(mcus: int) -> jpeg.Image:
    image = jpeg.Image(16 * mcus, 16, [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)])
    image.lay_out()
    return image


def tiles(payload: bytes) -> list[bytes]:
    """The payload in pieces that each fill one image."""
    most = MOST_MCUS * BLOCKS_IN_MCU * UNIT
    return [payload[i : i + most] for i in range(0, len(payload), most)]


def store(pieces: list[bytes]) -> list[bytes]:
    """A JPEG of each piece; its last MCU is filled with blocks of zeros."""
    images, coefs = [], []
    for piece in pieces:
        blocks = np.frombuffer(piece, np.uint8).reshape(-1, UNIT)
        image = blank_image(-(-len(blocks) // BLOCKS_IN_MCU))
        full = np.zeros((image.blocks, UNIT), np.int64)
        full[: len(blocks)] = blocks
        images.append(image)
        coefs.append(full)
    return jpeg.write(coefs, images)


def load(files: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each file's coefficients as bytes, and its RGB tensor."""
    images = [jpeg.parse(f) for f in files]
    coefs = jpeg.accumulate(images)
    at = 0
    for image in images:
        own = coefs[at : at + image.blocks]
        at += image.blocks
        yield own.astype(np.uint8).tobytes(), jpeg.to_rgb(image, own)


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``most`` bytes together."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if lengths:
        yield begin, len(lengths)


def describe(tensors: list[np.ndarray]) -> str:
    """Size, means and deviations of the three channels over a document's images, and a checksum of all pixels."""
    count = sum(t.shape[0] * t.shape[1] for t in tensors)
    sums = sum(t.sum(axis=(0, 1), dtype=np.int64) for t in tensors)
    squares = sum(np.einsum("ijk,ijk->k", t.astype(np.int64), t.astype(np.int64)) for t in tensors)
    means = sums / count
    deviations = np.sqrt(np.maximum(squares / count - means**2, 0))
    sizes = f"{sum(t.shape[1] for t in tensors)}x{tensors[0].shape[0]}"
    pixels = 0
    for t in tensors:
        pixels = zlib.crc32(np.ascontiguousarray(t), pixels)
    return " ".join([sizes, *(f"{x:.3f}" for x in (*means, *deviations)), f"{pixels:08x}"])


def media_rows(texts: list[str | None]) -> Iterator[tuple[list[bytes], bytes, int, list[np.ndarray]]]:
    """For each text the stored images, the payload as read back from them, the text's bytes, and the RGB tensors."""
    payloads = [padded(t) for t in texts]
    pieces = [(i, p) for i, (data, _) in enumerate(payloads) for p in tiles(data)]
    files: list[bytes] = []
    back: list[tuple[bytes, np.ndarray]] = []
    at = 0
    # Pieces of several documents go through the arrays together; a document's rows come out once all its pieces are read.
    for a, b in slices([len(p) for _, p in pieces], SLICE):
        made = store([p for _, p in pieces[a:b]])
        files += made
        back += load(made)
        while at < len(texts):
            n = len(tiles(payloads[at][0]))
            if len(files) < n:
                break
            data = b"".join(x[0] for x in back[:n])[: len(payloads[at][0])]
            yield files[:n], data, payloads[at][1], [x[1] for x in back[:n]]
            del files[:n], back[:n]
            at += 1


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
DIGEST_NAMES = [x.split()[0] for x in DIGESTS.split(", ")]
STORED = "doc_id long, n_bytes long, media array<binary>, tensors array<struct<height:int,width:int,rgb:binary>>, feature string"
TENSOR = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, media (its images), tensors (of each image the full-resolution RGB bytes by row, column and
    channel, with height and width) and feature; with digests, these instead of images and tensors.

    Null texts count as empty and take one block of zeros. Whole texts are
    stored; those of over MOST_MCUS * 384 bytes take several images. Equal texts
    have equal media and features. payload_sha256 and tail_crc32 are of what
    was read back from the images. An empty table gives no rows.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = media_rows(batch.column(1).to_pylist())
            out = []
            for media, payload, n, pixels in rows:
                if digests:
                    whole = b"".join(media)
                    out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(whole), hashlib.sha256(whole).hexdigest(), describe(pixels)))
                else:
                    out.append((n, media, [(t.shape[0], t.shape[1], t.tobytes()) for t in pixels], describe(pixels)))
            columns = list(zip(*out)) or [[]] * (7 if digests else 4)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.binary()), pa.list_(TENSOR), pa.string()]
            names = DIGEST_NAMES if digests else ["doc_id", "n_bytes", "media", "tensors", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, DIGESTS if digests else STORED)


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, image (its place), height, width and rgb (bytes, by row, column and channel), read again from the stored images."""
    small_batches(media.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, files in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, (_, rgb) in enumerate(load(files.as_py() or [])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id], pa.int64()), pa.array([i], pa.int32()), pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary())],
                        names=["doc_id", "image", "height", "width", "rgb"],
                    )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, image int, height int, width int, rgb binary")


def op8_media_jpeg(spark, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), digests=True)
