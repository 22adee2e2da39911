"""Repeated byte strings, found by a column-wise multi-document suffix order.

The collection is first cut so that its parts can be ordered apart. Each window
of WIDTH bytes has an anchor, its leftmost byte string of GRAM bytes with the
least hash; equal windows have equal anchors at equal places. Consecutive
windows with one anchor are a run, and a run's bytes are its context. So equal
windows are found by comparing contexts of one anchor, aligned at the anchor:

1. Equal contexts are counted; where one occurs twice, all its windows repeat.
2. Of anchors that have several contexts, one row for each different context
   goes to the column-wise construction: every round inserts one more symbol of
   each context in front of what it has of it so far, and updates the order of
   these suffixes (the Burrows-Wheeler order of that column) and the common
   prefixes of neighbours. A window repeats if its suffix shares WIDTH symbols
   with a neighbour. As a round only needs the one before, a round is one
   sequential pass over a column, and the rounds are as many as a context is
   long, whatever the length of the documents.
3. Anchors with very many contexts are split: their windows are dealt by ranges
   of their places, with more common bytes in the key, and go to 1 again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .media import slices

WIDTH = 200
GRAM = 32
#: Windows that can have one anchor: its place in them runs from 0 to REACH.
REACH = WIDTH - GRAM
#: Bytes of text that are worked on together; a longer text goes in pieces that overlap by WIDTH - 1 bytes.
SLICE = 1 << 20
#: Contexts of one anchor that go to one task; more are split.
MOST_CONTEXTS = 1024
#: Ranges of places that such a split makes.
PARTS = 8
#: Contexts that one construction orders together.
CHUNK = 8192
ABSENT = 0xFF  # no byte of UTF-8

# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    n = data.size - GRAM + 1
    word = np.ndarray(data.size - 7, "<u8", data.tobytes(), strides=(1,))
    mixed = np.zeros(n, np.uint64)
    # Odd constants from the fractional part of the golden ratio, times odd numbers.
    for i in range(GRAM // 8):
        mixed += word[8 * i : 8 * i + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` consecutive ones."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: keys.size - (width - span)], keys[width - span :]) if width > span else keys


def runs(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """For all runs of the pieces: piece, first and last window, anchor, its hash; places are those in all pieces together."""
    joined = b"".join(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    none = np.zeros(0, np.int64)
    if len(joined) < WIDTH:
        return none, none, none, none, none, joined
    hashes = gram_hashes(np.frombuffer(joined, np.uint8))
    keys = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(hashes.size, dtype=np.uint64)
    anchor = (sliding_least(keys, REACH + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.searchsorted(ends, np.arange(anchor.size), side="right")
    inside = np.arange(anchor.size) + WIDTH <= ends[piece]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))) & inside
    first = np.flatnonzero(new)
    # A run ends where the next begins or where the piece has no more windows.
    stop = np.minimum(np.concatenate((first[1:], [anchor.size])), ends[piece[first]] - WIDTH + 1)
    return piece[first], first, stop - 1, anchor[first], hashes[anchor[first]].view(np.int64), joined


def text_pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of pieces of about SLICE bytes: whose they are, where they begin, and their bytes."""
    owner, begin, found = [], [], []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data) - WIDTH + 1, 0), SLICE):
            owner.append(i)
            begin.append(at)
            found.append(data[at : at + SLICE + WIDTH - 1])
    for a, b in slices([len(p) for p in found], SLICE):
        yield owner[a:b], begin[a:b], found[a:b]


ANCHORS = "doc_id long, rid long, place int, first int, last int, anchor long, context long"


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rids = batch.column(0), batch.column(1)
        for owner, begin, pieces in text_pieces(batch.column(2).to_pylist()):
            piece, first, last, anchor, key, joined = runs(pieces)
            hashed = xxhash.xxh64_intdigest
            bounds = zip(first.tolist(), (last + WIDTH).tolist(), (anchor - first).tolist())
            context = np.fromiter((hashed(joined[a:b], off) for a, b, off in bounds), np.uint64, first.size)
            starts = np.cumsum([0] + [len(p) for p in pieces])[:-1]
            row = np.array(owner, np.int64)[piece]
            place = anchor - starts[piece] + np.array(begin, np.int64)[piece]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(row)),
                    rids.take(pa.array(row)),
                    pa.array(place.astype(np.int32)),
                    pa.array((first - anchor).astype(np.int32)),
                    pa.array((last - anchor).astype(np.int32)),
                    pa.array(key),
                    pa.array(context.view(np.int64)),
                ],
                names=[x.split()[0] for x in ANCHORS.split(", ")],
            )


# ---------------------------------------------------------------- contexts


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of text and the runs that are wanted of it; gives each run's bytes."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                bytes_ = data[w["place"] + w["first"] : w["place"] + w["last"] + WIDTH]
                out.append((w["anchor"], w["context"], w["first"], w["last"], bytes_))
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "context", "first", "last", "bytes"])


def common_prefix_hits(contexts: list[bytes], firsts: np.ndarray) -> np.ndarray:
    """contexts begin at ``firsts`` (0 or below) from their anchor. For each and each place, whether the window there repeats.

    The column-wise construction: columns are places from the anchor, from the
    last to the first. order has the contexts by their suffix from the column
    on, common the symbols that a suffix shares with the one before it (WIDTH
    stands for all from there on). The symbols to insert next, in that order,
    are the Burrows-Wheeler transform of the column; sorting them, stably, gives
    the next order. Where a context has no symbol it shares none.
    """
    m, columns = len(contexts), REACH + WIDTH
    symbols = np.full((m, columns), ABSENT, np.uint8)
    for i, (data, first) in enumerate(zip(contexts, firsts.tolist())):
        symbols[i, REACH + first : REACH + first + len(data)] = np.frombuffer(data, np.uint8)
    symbols = np.ascontiguousarray(symbols.T)
    hits = np.zeros((REACH + 1, m), bool)
    order, common = np.arange(m), np.zeros(m, np.uint8)
    log = np.zeros(m + 1, np.int64)
    for i in range(2, m + 1):
        log[i] = log[i >> 1] + 1
    for column in range(columns - 1, -1, -1):
        transform = symbols[column][order]
        moved = np.argsort(transform, kind="stable")
        before, after = moved[:-1], moved[1:]
        symbol = transform[moved]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != ABSENT))
        shared = np.zeros(m, np.uint8)
        if same.size:
            low, high = before[same] + 1, after[same]
            level = log[high - low + 1]
            least = np.full(same.size, WIDTH, np.uint8)
            least_of = common
            # least_of[i]: the least of common from i on, over 2^step places.
            for step in range(int(level.max()) + 1):
                if step:
                    least_of = np.minimum(least_of[: -(1 << step - 1)], least_of[1 << step - 1 :])
                at = np.flatnonzero(level == step)
                least[at] = np.minimum(least_of[low[at]], least_of[high[at] - (1 << step) + 1])
            shared[same + 1] = np.minimum(least, WIDTH - 1) + 1
        order, common = order[moved], shared
        if column <= REACH:
            full = np.flatnonzero(common == WIDTH)
            hits[column, order[full]] = True
            hits[column, order[full - 1]] = True
    return hits.T


def intervals(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and inclusive ranges of places (from the anchor) of what is true."""
    edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    return row, begin - REACH, end - 1 - REACH


def _order_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, sorted by key; each chunk has all contexts of its keys."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        row, begin, end = intervals(common_prefix_hits([r[4] for r in rows], np.array([r[3] for r in rows], np.int64)))
        anchor, context = np.array([r[1] for r in rows], np.int64)[row], np.array([r[2] for r in rows], np.int64)[row]
        columns = [pa.array(anchor), pa.array(context), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "from", "to"])

    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if len(rows) >= CHUNK and r[0] != rows[-1][0]:
                yield flush(rows)
                rows = []
            rows.append(r)
    if len(rows) > 1:
        yield flush(rows)


FOUND = "anchor long, context long, `from` int, `to` int"


def repeated_places(contexts: DataFrame, most: int = MOST_CONTEXTS) -> DataFrame:
    """contexts: anchor, context, first, last, bytes, different ones of anchors that have several.

    Gives anchor, context and inclusive ranges of windows (places from the
    anchor) that other contexts of the anchor have too. Keys with up to
    ``most`` contexts are ordered by a task; those with more are split by their
    places, down to single windows, which counting settles.
    """
    found = None
    level = contexts.select(
        F.col("anchor").alias("key"), "anchor", "context", "first", "last", "bytes", F.lit(-REACH).alias("low"), F.lit(0).alias("high")
    )
    while True:
        # Written, so that the joins with it read both sides from shuffles, which Spark can split where a key is large.
        sizes = materialize(level.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "context-counts")
        few = level.join(sizes.filter(F.col("n") <= most), "key", "left_semi")
        ordered = few.select("key", "anchor", "context", "first", "bytes").repartition("key").sortWithinPartitions("key")
        part = ordered.mapInArrow(_order_batches, FOUND)
        found = part if found is None else found.unionByName(part)
        many = sizes.filter(F.col("n") > most)
        if many.isEmpty():
            return found
        split = split_places(level.join(many, "key", "left_semi")).withColumn("text", F.sha2("bytes", 256))
        split = materialize(split, "context-parts")
        # Equal parts: all their windows repeat, and one of them goes on.
        same = ["key", "first", "last", "text"]
        groups = split.groupBy(*same).agg(F.count("*").alias("copies"), F.min(F.struct("anchor", "context")).alias("one"))
        groups = materialize(groups, "context-copies")
        twice = split.join(groups.filter("copies > 1").select(*same), same, "left_semi")
        found = found.unionByName(twice.select("anchor", "context", F.col("first").alias("from"), F.col("last").alias("to")))
        ones = groups.select(*same, "one.anchor", "one.context")
        level = split.filter("low < high").join(ones, [*same, "anchor", "context"], "left_semi").drop("text")


def split_places(level: DataFrame) -> DataFrame:
    """Each context's windows in PARTS ranges of the places low to high; the key takes in the bytes that all windows of a range have."""
    step = F.ceil((F.col("high") - F.col("low") + 1) / PARTS).cast("int")
    part = level.withColumn("step", step).withColumn("side_low", F.explode(F.sequence("low", "high", "step")))
    part = part.withColumn("side_high", F.least(F.col("side_low") + F.col("step") - 1, "high"))
    part = part.withColumn("begin", F.greatest("first", "side_low")).withColumn("end", F.least("last", "side_high")).filter("begin <= end")
    core = F.substring("bytes", F.col("side_high") - F.col("first") + 1, F.col("side_low") + WIDTH - F.col("side_high"))
    return part.select(
        F.xxhash64("key", "side_low", core).alias("key"),
        "anchor",
        "context",
        F.col("begin").alias("first"),
        F.col("end").alias("last"),
        F.substring("bytes", F.col("begin") - F.col("first") + 1, F.col("end") + WIDTH - F.col("begin")).alias("bytes"),
        F.col("side_low").alias("low"),
        F.col("side_high").alias("high"),
    )


# ---------------------------------------------------------------- documents


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that half-open spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removal(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                gone = merge([(s["a"], s["b"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                value = hashlib.sha256(rest).hexdigest() if digests else rest
                out.append((doc_id, len(data), len(data) - len(rest), len(gone), value))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string() if digests else pa.binary()]
            names = [x.split()[0] for x in (DIGESTS if digests else CLEANED).split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, most: int = MOST_CONTEXTS
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept; with digests, kept_sha256 for kept.

    Every byte goes that lies in a string of WIDTH bytes which also starts
    elsewhere, in the same document or another; strings are judged on the
    input. Null texts count as empty; texts under WIDTH bytes keep all. Rows
    that repeat a text, with one id or several, remove each other's bytes. An
    empty table gives no rows. Anchors and contexts are compared by 64-bit
    hashes each, together 128 bits; what is ordered is compared by its bytes.
    """
    small_batches(docs.sparkSession, 500)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"))
    anchors = materialize(rows.filter(F.octet_length("text") >= WIDTH).mapInArrow(_anchor_batches, ANCHORS), "anchors")

    shared = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
    anchors = materialize(anchors.join(shared, "anchor", "left_semi"), "anchors-shared")
    groups = anchors.groupBy("anchor", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "place", "first", "last")).alias("one")
    )
    groups = materialize(groups, "contexts")
    several = materialize(groups.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "several-contexts")
    wanted = groups.join(several, "anchor", "left_semi").select(
        F.col("one.doc_id").alias("_id"), F.col("one.rid").alias("_rid"), F.struct("anchor", "context", "one.place", "one.first", "one.last").alias("run")
    )
    wanted = wanted.groupBy("_id", "_rid").agg(F.collect_list("run").alias("runs"))
    own = (rows["rid"] == F.col("_rid")) & rows["doc_id"].eqNullSafe(F.col("_id"))
    found = rows.join(wanted, own).select("text", "runs").mapInArrow(
        _context_batches, "anchor long, context long, first int, last int, bytes binary"
    )
    contexts = materialize(found.dropDuplicates(["anchor", "context"]), "context-bytes")
    places = repeated_places(contexts, most)

    full = groups.filter("copies > 1").select("anchor", "context", F.col("one.first").alias("from"), F.col("one.last").alias("to"))
    places = full.unionByName(places).groupBy("anchor", "context").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    places = materialize(places, "repeated-places")
    spans = anchors.join(places, ["anchor", "context"]).select("doc_id", "rid", "place", F.explode("ranges").alias("r"))
    spans = spans.select("doc_id", "rid", F.struct((F.col("place") + F.col("r.from")).alias("a"), (F.col("place") + F.col("r.to") + WIDTH).alias("b")).alias("s"))
    by_doc = spans.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid")).agg(F.collect_list("s").alias("spans"))
    joined = rows.join(by_doc, own, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removal(digests), DIGESTS if digests else CLEANED)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
