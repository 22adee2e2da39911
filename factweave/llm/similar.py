"""Near duplicates of word shingles at a stated similarity: SimHash with covering masks, then an exact way for the rest.

Each text's set of shingles has a SimHash. Covering masks (covering.py) find
all pairs whose fingerprints differ in RADIUS bits at most; of these, the sets
decide which are links. A SimHash of 64 bits can't carry a similarity of 0.8
alone: such pairs differ in about 10 bits, give or take 3, and masks that cover
16 bits would take 131,071 tables. So what the fingerprints have not joined is
looked for by prefixes of the sets. Take all shingles in one order: a pair
within similarity s, of sets of n shingles, has at most n - ceil(s * n) in each
that the other lacks, so among the first n - ceil(s * n) + 1 of each there is
one that both have, and the pair meets in that shingle's table. The order is
by rarity, from a sketch of counts over all texts, so that a passage that a
third of the texts share comes last and makes no large tables.

Within the tables pairs are not listed. Each text carries a second
fingerprint, the parities of its shingles in 512 bins: two texts' fingerprints
differ in no more bits than their sets do, so a pair that differs in more bits
than its sizes allow is out. Texts are first compared with the most typical
text of their tables, unless the SimHash has joined them; what is similar to it
is one component, and only pairs across components are looked at afterwards. Every link is decided by the sets
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, quoted, small_batches
from .components import connected_components
from .covering import majority, near_edges

#: Counters of the sketch by which shingles are ordered from rare to frequent.
COUNTERS = 1 << 16
#: Bits in which SimHash fingerprints may differ for the masks to find them; a bucket of more fingerprints than SMALL is dealt again.
RADIUS = 3
SMALL = 128
#: Bits of the parity fingerprint.
PARITIES = 512
SEED = 7
#: Texts of a table that one task compares with one another; a larger table is dealt to pairs of its parts.
PART = 2048
#: Rows that are compared with a part at once.
AT_ONCE = 64


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of the text's different shingles of lower-cased words, ascending; of fewer words the whole sequence is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    return np.unique(np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle, by counter, over all texts. What comes to the driver is one row for each counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (shingles(text.as_py(), width) % np.uint64(COUNTERS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["counter", "n"])

    sums = rows.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for r in sums.collect():
        out[r["counter"]] = r["n"]
    return out


def signature(found: np.ndarray, seen: np.ndarray, tenths: int) -> tuple[np.ndarray, float, bytes]:
    """The shingles that a text's masks keep, rare ones first; how typical the text is; and its parity fingerprint."""
    n = found.size
    common = seen[(found % np.uint64(COUNTERS)).astype(np.int64)]
    prefix = found[np.lexsort((found, common))][: n - -(-tenths * n // 10) + 1]
    bins = ((found >> np.uint64(32)) % np.uint64(PARITIES)).astype(np.int64)
    return prefix, float(np.log1p(common).mean()), np.packbits(np.bincount(bins, minlength=PARITIES) & 1).tobytes()


SIGNED = "rid long, n int, typical double, parity binary, fp long, prefix array<long>"


def signatures(rows: DataFrame, width: int, tenths: int) -> DataFrame:
    seen = frequencies(rows, width)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, typical, parity, prints, prefix = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                first, mean, bits = signature(found, seen, tenths)
                sizes.append(found.size)
                typical.append(mean)
                parity.append(bits)
                prints.append(majority(found))
                prefix.append(first.view(np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(typical, pa.float64()), pa.array(parity, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "n", "typical", "parity", "fp", "prefix"])

    return rows.select("rid", "text").mapInArrow(sign, SIGNED)


def may_be_similar(na, nb, tenths: int):
    """Sizes that allow the similarity."""
    return (10 * F.least(na, nb)) >= (tenths * F.greatest(na, nb))


def print_pairs(signed: DataFrame) -> DataFrame:
    """Pairs a, b of texts (signed: rid, fp) by their fingerprints: the first texts of fingerprints that differ in 1 to RADIUS bits, and each other text with the first of its own."""
    least = materialize(signed.groupBy("fp").agg(F.min("rid").alias("first"), F.count("*").alias("texts")), "distinct-prints")
    ends = lambda c: least.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    edges = near_edges(least, RADIUS, SMALL).distinct()
    apart = edges.join(ends("u"), "u").join(ends("v"), "v").select("first_u", "first_v")
    same = signed.select("rid", "fp").join(least.filter("texts > 1"), "fp").filter("rid != first").select("first", "rid")
    return apart.unionAll(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def parities(found: np.ndarray) -> bytes:
    """The parities of a set's members in at least four bins for each; halves of it, one upon the other, are its parities in half as many bins."""
    bins = max(64, 1 << int(4 * found.size - 1).bit_length())
    return np.packbits(np.bincount(((found >> np.uint64(24)) % np.uint64(bins)).astype(np.int64), minlength=bins) & 1).tobytes()


def parities_differ(a: bytes, b: bytes) -> int:
    """In how many of the bins that both can be folded to the parities differ: in no more than the sets differ in members."""
    x, y = (np.frombuffer(c, np.uint8) for c in (a, b))
    while x.size != y.size:
        if x.size < y.size:
            x, y = y, x
        x = x[: x.size // 2] ^ x[x.size // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _parity_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([f.size for f in found], pa.int32()), pa.array([parities(f) for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "n", "parities"])

    return run


def _near_batches(tenths: int):
    """Leaves out the pairs (a, b, n_a, n_b, p_a, p_b) whose parities differ in more bins than sets within the similarity can in members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [
                (10 + tenths) * parities_differ(x, y) <= (10 - tenths) * (n + m)
                for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "p_a", "p_b")))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["rid", "found"])

    return run


def asked_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """rid, text of the texts that pairs have. The ids are written first, so that Spark broadcasts them by their size where they are few."""
    asked = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    return rows.select("rid", "text").join(materialize(asked, "asked-texts"), "rid", "left_semi")


def similar(pairs: DataFrame, rows: DataFrame, width: int, tenths: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles are similar enough.

    First parities in bins that grow with the text, which take half a byte for
    a member of the set, leave out pairs that differ in too many; for what is
    left the sets themselves are sent, whole hashes of 64 bits, and decide.
    """
    bits = materialize(asked_of(pairs, rows).mapInArrow(_parity_batches(width), "rid long, n int, parities binary"), "wide-parities")
    side = lambda c: bits.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parities").alias(f"p_{c}"))
    near = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near_batches(tenths), "a long, b long"), "near-pairs")
    sets = materialize(asked_of(near, rows).mapInArrow(_set_batches(width), "rid long, found array<long>"), "shingle-sets")
    both = near.join(sets.select(F.col("rid").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("found").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter((10 + tenths) * common >= tenths * (F.size("x") + F.size("y"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _across_batches(tenths: int):
    """Rows of a partition, sorted by table and parts; gives the pairs across components that sizes and parities allow."""

    def pairs_of(group: list[tuple], same: bool, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part, rid, n, comp = (np.array([g[i] for g in group], np.int64) for i in (3, 4, 5, 6))
        bits = np.frombuffer(b"".join(g[7] for g in group), np.uint64).reshape(len(group), -1)
        mine = np.arange(len(group)) if same else np.flatnonzero(part == left)
        other = mine if same else np.flatnonzero(part != left)
        for i in range(0, mine.size, AT_ONCE):
            x = mine[i : i + AT_ONCE, None]
            y = other[None, :]
            ok = (comp[x] != comp[y]) & (10 * np.minimum(n[x], n[y]) >= tenths * np.maximum(n[x], n[y]))
            if same:
                ok &= x < y
            p, q = np.nonzero(ok)
            p, q = mine[i + p], other[q]
            differing = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
            # Of sets within the similarity, the symmetric difference is at most (1 - s) / (1 + s) of the sizes' sum.
            good = (10 + tenths) * differing <= (10 - tenths) * (n[p] + n[q])
            yield np.minimum(rid[p[good]], rid[q[good]]), np.maximum(rid[p[good]], rid[q[good]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for (_, low, high), group in groupby(rows, key=lambda r: r[:3]):
            for a, b in pairs_of(list(group), low == high, low):
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def across_components(met: DataFrame, signed: DataFrame, parts: DataFrame, tenths: int) -> DataFrame:
    """Pairs a, b of texts of one table (met: mask, rid) that are in different components and may be similar.

    A table of over PART texts is dealt to pairs of its parts, so that no task
    has more than twice that; tables within one component are left out.
    """
    own = met.select("mask", "rid").join(parts, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    open_ = own.groupBy("mask").agg(F.count("*").alias("texts"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("mask", "texts")
    kept = own.join(open_, "mask")
    split = F.ceil(F.col("texts") / PART).cast("int")
    kept = kept.withColumn("split", split).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("split")).cast("int"))
    dealt = kept.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    dealt = dealt.join(signed.select("rid", "n", "parity"), "rid").select(
        "mask", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "rid", "n", "comp", "parity"
    )
    sorted_ = dealt.repartition("mask", "first", "second").sortWithinPartitions("mask", "first", "second")
    return sorted_.mapInArrow(_across_batches(tenths), "a long, b long").distinct()


def similar_groups(docs: DataFrame, key: str, text_col: str = "text", width: int = 5, tenths: int = 8) -> DataFrame:
    """key, component: for each row that is near another, the smallest key that links reach; other rows are left out.

    Links join rows whose sets of ``width``-word shingles (A-Z lower-cased)
    have a Jaccard similarity of ``tenths`` / 10 at least. Null texts count as
    empty; texts without words are equal to one another. key: a column that no
    two rows share, a long or a struct with a long ``n`` that no two rows share.
    Whole texts are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    own = quoted(key)
    kind = docs.schema[key].dataType
    rid = own["n"] if isinstance(kind, StructType) else F.coalesce(own, F.lit(-(1 << 63)))
    rows = docs.select(rid.alias("rid"), F.col(text_col).alias("text"))
    signed = materialize(signatures(rows, width, tenths), "signatures")
    prints = allowed(materialize(print_pairs(signed), "print-pairs"), signed, tenths)
    joined = materialize(similar(materialize(prints, "near-prints"), rows, width, tenths), "print-links")
    known = materialize(connected_components(joined), "print-components")

    masks = signed.select(F.explode("prefix").alias("mask"), "rid", "n", "typical")
    shared = materialize(masks.groupBy("mask").agg(F.count("*").alias("texts")).filter("texts > 1").select("mask"), "shared-masks")
    met = materialize(masks.join(shared, "mask", "left_semi"), "met-texts")

    # The most typical text of each table, and for each text the two of these that it meets most often.
    typical = met.groupBy("mask").agg(F.max(F.struct("typical", "rid", "n")).alias("top")).select("mask", F.col("top.rid").alias("top"), F.col("top.n").alias("top_n"))
    asked = met.join(typical, "mask").filter("rid != top").filter(may_be_similar(F.col("n"), F.col("top_n"), tenths)).groupBy("rid", "top").agg(F.count("*").alias("times"))
    place = Window.partitionBy("rid").orderBy(F.desc("times"), "top")
    asked = asked.withColumn("place", F.row_number().over(place)).filter("place <= 2").select(F.least("rid", "top").alias("a"), F.greatest("rid", "top").alias("b")).distinct()
    comp = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}"))
    open_ = asked.join(comp("a"), "a", "left").join(comp("b"), "b", "left").filter(F.coalesce(F.col("comp_a") != F.col("comp_b"), F.lit(True))).select("a", "b")
    stars = similar(materialize(allowed(open_, signed, tenths), "star-pairs"), rows, width, tenths)
    stars = materialize(stars.unionByName(joined), "star-links")
    parts = connected_components(stars).select(F.col("node").alias("rid"), F.col("component").alias("comp"))

    pairs = materialize(across_components(met, signed, materialize(parts, "star-components"), tenths), "pairs-across")
    links = stars.unionByName(similar(pairs, rows, width, tenths))
    found = materialize(connected_components(links), "near-components")
    keys = docs.select(own.alias("key"), rid.alias("rid"))
    of = keys.join(found, keys["rid"] == found["node"]).select("key", F.col("component").alias("comp"))
    of = materialize(of, "near-keys")
    least = of.groupBy("comp").agg(F.min("key").alias("component"))
    return of.join(least, "comp").select("key", "component")


def allowed(pairs: DataFrame, signed: DataFrame, tenths: int) -> DataFrame:
    """Those of the pairs a, b whose parity fingerprints differ in no more bits than sets within the similarity can in members."""
    sides = lambda c: signed.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    both = pairs.join(sides("a"), "a").join(sides("b"), "b")
    return both.filter((10 + tenths) * bits_between(F.col("p_a"), F.col("p_b")) <= (10 - tenths) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def bits_between(a, b):
    """How many bits of two fingerprints differ, four bytes at a time."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, 4 * i + 1, 4)), 16, 10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(PARITIES // 32)), F.lit(0))
