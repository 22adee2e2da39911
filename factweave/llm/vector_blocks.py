"""Integer vectors in lists, a stated query set in blocks, and the round in which every list meets every block.

Both searches over ``embeddings`` (hard negatives, exact top-k) ask every row
of a stated set against all rows. Rows are packed where they are, without a
shuffle, into lists of a bounded number; queries into blocks of a bounded
number. A round joins lists with blocks, so that its rows are pairs of a list
and a block, never of a row and a query; what a task passes on is its best few
for each query. A first round over a sixteenth of the lists gives each query
a score that its result can't fall below; so what the round over all lists
passes on grows with the number of queries, not with queries times tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize

ROWS = 2048
QUERIES = 1024
#: Of the lists, one in so many takes part in the first round.
SAMPLE = 16
#: Stands for no number among notes.
NONE = -(1 << 63)
#: Pairs of a list and a block that one Arrow batch holds; each has some MB at most.
PAIRS_AT_ONCE = 16

PACKED = "ids binary, kind string, width int, flat binary, noted int, notes binary"


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, notes: Column) -> DataFrame:
    """id, v (floor(scale * x) of each component x as double), notes (longs) of the rows that take part.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    return whole.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), notes.alias("notes"))


def _padded(column: pa.ListArray, fill: int) -> np.ndarray:
    """The lists as the rows of a matrix; shorter ones end in ``fill``."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.full((len(lengths), width), fill, np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _pack(size: int):
    def one(rows: pa.Table) -> pa.RecordBatch:
        m, notes = (_padded(rows.column(c).combine_chunks(), fill) for c, fill in (("v", 0), ("notes", NONE)))
        kind = next(k for k in ("<i2", "<i4", "<i8") if not m.size or np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max)
        ids = np.ascontiguousarray(rows.column("id").to_numpy(), "<i8")
        cells = [ids.tobytes(), kind, m.shape[1], m.astype(kind).tobytes(), notes.shape[1], notes.astype("<i8").tobytes()]
        kinds = [pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=[x.split()[0] for x in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield one(rows.slice(0, size))
                held, n = rows.slice(size).to_batches(), n - size
        if n:
            yield one(pa.Table.from_batches(held))

    return run


def packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """The vectors in rows of at most ``size`` each, written to the shared folder."""
    ship_package(vectors.sparkSession)
    return materialize(vectors.select("id", "v", "notes").mapInArrow(_pack(size), PACKED), name)


def lists(vectors: DataFrame) -> DataFrame:
    return packed(vectors, ROWS, "vector-lists")


def some_of(row_lists: DataFrame) -> DataFrame:
    """The lists of the first round, chosen by a hash of their ids."""
    return row_lists.filter(F.pmod(F.xxhash64("ids"), F.lit(SAMPLE)) == 0)


def blocks(queries: DataFrame) -> DataFrame:
    """The queries in blocks; an id that several rows have asks once, with the smallest vector."""
    once = queries.groupBy("id").agg(F.min(F.struct("v", "notes")).alias("own")).select("id", "own.v", "own.notes")
    once = materialize(once, "queries")
    return packed(once.repartition(max(1, -(-once.count() // QUERIES)), "id"), QUERIES, "query-blocks")


@dataclass
class Block:
    ids: np.ndarray
    vectors: np.ndarray
    notes: np.ndarray


def _unpacked(row: dict, side: str) -> Block:
    ids = np.frombuffer(row[f"{side}ids"], "<i8")
    of = lambda cell, kind, width: np.frombuffer(row[side + cell], kind).astype(np.int64).reshape(len(ids), width)
    return Block(ids, of("flat", row[f"{side}kind"], row[f"{side}width"]), of("notes", "<i8", row[f"{side}noted"]))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with the columns of the wider one; what is missing is zero."""
    width = max(a.shape[1], b.shape[1])
    wide = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return wide(a), wide(b)


def fits(a: np.ndarray, b: np.ndarray) -> None:
    """Raises ArithmeticError if an inner product of rows of a and b could leave 64 bits."""
    most = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    if most(a) * most(b) * max(a.shape[1], 1) >= 1 << 62:
        raise ArithmeticError("components are so large that scores don't fit into 64 bits")


def meet(row_lists: DataFrame, asked: DataFrame, start: Callable, schema: str, name: str) -> DataFrame:
    """One round: every list meets every block of the stated query set.

    start(block) gives an object whose add(list) takes a list in and whose
    rows() gives what the task passes on for the block. The result is written
    to the shared folder.
    """
    spark = row_lists.sparkSession
    left = row_lists.select(*[F.col(c).alias(f"r_{c}") for c in row_lists.columns])
    right = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going: dict[bytes, object] = {}
        last, rows = b"", None
        for batch in batches:
            for pair in batch.to_pylist():
                if rows is None or pair["r_ids"] != last:
                    last, rows = pair["r_ids"], _unpacked(pair, "r_")
                key = pair["q_ids"]
                if key not in going:
                    going[key] = start(_unpacked(pair, "q_"))
                going[key].add(rows)
        for one in going.values():
            yield one.rows()

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PAIRS_AT_ONCE))  # read when the plan runs, which it does here
    try:
        return materialize(left.crossJoin(right).mapInArrow(run, schema), name)
    finally:
        spark.conf.set(key, before)
