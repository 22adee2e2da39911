"""SimHash bits from hashes, and covering masks that find all pairs of fingerprints within a radius (see simhash.py)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 64
BITS_AT_ONCE = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes: of its 64 bits, one is set where over half of them have it set."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, hashes.size, BITS_AT_ONCE):
        as_bytes = hashes[i : i + BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(as_bytes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > hashes.size).tobytes(), "big")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the free bits, such that any ``radius`` of these are all absent from some mask.

    The i-th free position's code runs through 1 .. 2^(radius+1) - 1 in turn, so that masks are about equally wide.
    """
    codes = 2 ** (radius + 1) - 1
    places = [i for i in range(BITS) if free >> i & 1]
    code = {p: i % codes + 1 for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (code[p] & v).bit_count() % 2) for v in range(1, codes + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_edges(prints: DataFrame, radius: int = 2, small: int = 64, levels: int = 8) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) that differ in 1 to ``radius`` bits; each link at least once.

    small: a bucket of more is dealt again; 64 at least for radius 2, since a bucket with under 7 free bits holds no more.
    In general with 2^radius free bits at least no mask is empty, so a bucket must not be dealt again with fewer.
    """
    least = max(64, 2 ** 2**radius // 2)
    if small < least:
        raise ValueError(f"small must be {least} at least")
    edges = None
    every = (1 << BITS) - 1
    # At each level, ``fixed`` has the bits in which all fingerprints of a bucket agree.
    level = prints.select("fp", F.lit(0).cast("long").alias("fixed"))
    pending = [0]
    for depth in range(levels):
        deeper: dict[int, list[int]] = {}
        for fixed in pending:
            deeper[fixed] = sorted({fixed | m for m in covering_masks(every & ~fixed, radius)})
        routes = F.create_map(*[x for f, ms in deeper.items() for x in (F.lit(signed(f)), F.array(*[F.lit(signed(m)).cast("long") for m in ms]))])
        dealt = (
            level.withColumn("fixed", F.explode(F.element_at(routes, F.col("fixed"))))
            .withColumn("value", F.col("fp").bitwiseAND(F.col("fixed")))
        )
        if depth:  # tables of several parents can have the same mask
            dealt = materialize(dealt.distinct(), "buckets")
        sizes = dealt.groupBy("fixed", "value").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = materialize(sizes, "bucket-sizes")
        few = dealt.join(sizes.filter(F.col("n") <= small).drop("n"), ["fixed", "value"])
        group = few.groupBy("fixed", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        pairs = (
            group.select("fps", F.explode("fps").alias("u"))
            .select("u", F.explode(F.filter("fps", lambda v: (v > F.col("u")) & (F.bit_count(v.bitwiseXOR(F.col("u"))) <= radius))).alias("v"))
        )
        edges = pairs if edges is None else edges.unionAll(pairs)
        many = sizes.filter(F.col("n") > small)
        pending = [r["fixed"] & every for r in many.select("fixed").distinct().collect()]
        if not pending:
            return edges
        level = dealt.join(many.drop("n"), ["fixed", "value"]).select("fp", "fixed")
    raise RuntimeError("buckets of distinct fingerprints stayed large")
