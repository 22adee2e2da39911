"""Exact work on pairs of rows with vectors: lists of rows meet as matrix products.

Products are taken in single floats, which tells what can't count; what may
count is worked out again in doubles, so the result is that of doubles. A list
has a bounded number of rows, and so has each strip of it that a task holds as
a matrix, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .graph import cut

#: Rows of a list; products of single floats are off by less than SLACK for unit vectors, whose components are few hundreds.
LIST = 8192
SLACK = 5e-5
#: Most products that a task holds at once.
STRIP = 1 << 20


def unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(size > 0, size, 1.0)[:, None]


def of_width(v: Column, width: int) -> Column:
    return F.when(F.size(v) == width, v).otherwise(F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width))


def comparable(v: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def width_of(rows: DataFrame, v: str = "v") -> int:
    return rows.agg(F.max(F.size(v))).first()[0] or 1


def units(flat, width: int) -> np.ndarray:
    """A list's vectors, which stand one after another, as unit rows."""
    return unit(flat.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def strips(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where a strip of a's rows begins, and its products with b's rows in single floats."""
    few, other = a.astype(np.float32), b.astype(np.float32).T
    rows = max(1, STRIP // max(1, len(b)))
    for i in range(0, len(a), rows):
        yield i, few[i : i + rows] @ other


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosines of unit rows, row by row, to six digits."""
    return np.round(np.einsum("ij,ij->i", a, b), 6) + 0.0


def lists_of(rows: DataFrame, key: str, parts: Column, width: int, *more: str) -> DataFrame:
    """key, part, ids, flat and the columns ``more``: rows (id, v) of a key dealt to its parts by their ids, each as one row of lists."""
    part = F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")
    own = rows.select(key, part, F.struct("id", of_width(F.col("v"), width).alias("v"), *more).alias("x"))
    own = own.groupBy(key, "part").agg(F.collect_list("x").alias("x"))
    return own.select(key, "part", F.col("x.id").alias("ids"), F.flatten("x.v").alias("flat"), *[F.col(f"x.{c}").alias(c) for c in more])


def lists_of_all(rows: DataFrame, parts: int, width: int, *more: str) -> DataFrame:
    return lists_of(rows.withColumn("_all", F.lit(0)), "_all", F.lit(parts), width, *more).drop("_all")


def twice(lists: DataFrame) -> tuple[DataFrame, list[str]]:
    """The lists with their columns named for the second of two, and these names."""
    names = [c for c in lists.columns if c != "list"]
    return lists.select(*[F.col(c).alias(f"{c}_y") if c in names else F.col(c) for c in lists.columns]), [f"{c}_y" for c in names]


def pairs_of_all(rows: DataFrame, width: int, least: float, size: int = LIST) -> DataFrame:
    """a, b, similarity of all pairs of rows (id, v), a < b, with a cosine of ``least`` at least. Every two lists meet once."""
    ship_package(rows.sparkSession)
    lists = cut(lists_of_all(rows, max(1, -(-rows.count() // size)), width))
    other, _ = twice(lists)
    met = lists.join(other, F.col("part") <= F.col("part_y"))
    kind = rows.schema["id"].dataType.simpleString()
    return met.mapInArrow(near_pairs(width, least), f"a {kind}, b {kind}, similarity double")


def near_pairs(width: int, least: float, once: bool = True):
    """For two lists (ids, flat, part and the same of the second): their near pairs; once: every two lists meet once, else both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (units(batch.column(c)[i], width) for c in ("flat", "flat_y"))
                one, two = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "ids_y"))
                own = once and batch.column("part")[i].as_py() == batch.column("part_y")[i].as_py()
                for at, near in strips(a, b):
                    x, y = np.nonzero(near >= least - SLACK)
                    x += at
                    wanted = one[x] != two[y] if once else one[x] < two[y]
                    wanted = wanted & (x < y) if own else wanted
                    x, y = x[wanted], y[wanted]
                    similar = cosines(a[x], b[y])
                    p, q = one[x[similar >= least]], two[y[similar >= least]]
                    columns = [pa.array(np.where(p < q, p, q)), pa.array(np.where(p < q, q, p)), pa.array(similar[similar >= least])]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity"])

    return run


def signal_pairs(rows: DataFrame, signals: dict[str, float], cosine: float, least: float, size: int = 512) -> DataFrame:
    """a, b, base, similarity and one weight for each signal, of the pairs within a key whose weighted sum may reach ``least``, a < b.

    rows: key, base (what the key itself gives), id, v and the columns of
    ``signals``, which give their weight where both rows have the same value. A
    pair that meets by several keys has a row for each. Keys of over ``size``
    rows are dealt to lists, every two of which meet; smaller ones share lists,
    in which only rows of one key count.
    """
    ship_package(rows.sparkSession)
    rows = cut(rows)
    width = width_of(rows)
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = sizes.filter(F.col("n") <= size).agg(F.sum("n")).first()[0] or 0
    own = F.when(F.col("n") > size, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-shared // size)))).cast("string"))
    parts = F.when(F.col("n") > size, F.ceil(F.col("n") / size)).otherwise(1).cast("int")
    dealt = rows.join(sizes, "key").withColumn("list", F.struct((F.col("n") > size).alias("large"), own.alias("name"), parts.alias("of")))
    lists = cut(lists_of(dealt, "list", F.col("list.of"), width, "key", "base", *signals))
    other, names = twice(lists)
    alone = lists.filter("list.of = 1").select("*", *[F.lit(None).cast(other.schema[c].dataType).alias(c) for c in names])
    met = lists.filter("list.of > 1").join(other.filter("list.of > 1"), "list").filter("part <= part_y").select(alone.columns)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"a {kind}, b {kind}, base double, similarity double, " + ", ".join(f"{s} double" for s in signals)
    return alone.unionByName(met).drop("list").mapInArrow(_signal_pairs(width, signals, cosine, least), out)


def nearest(rows: DataFrame, asked: DataFrame, k: int, rule: str = "", size: int = LIST, blocks: int = 1) -> DataFrame:
    """query_id, id, similarity: for each of the queries (id, v, tag) and each list of rows (id, v, tag) the k best of the list by rounded cosine, then by id.

    Queries and rows are dealt to lists, and every two of them meet. rule:
    "within" takes only rows of the same tag, "across" only rows of another;
    null tags are one tag. A query's own id is left out.
    """
    ship_package(rows.sparkSession)
    width = max(width_of(rows), width_of(asked))
    lists = cut(lists_of_all(rows, max(1, -(-rows.count() // size)), width, "tag"))
    other, _ = twice(lists_of_all(asked, max(blocks, -(-asked.count() // size)), width, "tag"))
    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, rows)]
    return lists.crossJoin(cut(other)).mapInArrow(_nearest(width, k, rule), f"query_id {kinds[0]}, id {kinds[1]}, similarity double")


def _nearest(width: int, k: int, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asked = batch.column("ids")[i].values, batch.column("ids_y")[i].values
                row_ids, own = ids.to_numpy(zero_copy_only=False), asked.to_numpy(zero_copy_only=False)
                b, a = (units(batch.column(c)[i], width) for c in ("flat", "flat_y"))
                tags = [c.fill_null("") for c in (batch.column("tag_y")[i].values, batch.column("tag")[i].values)]
                mine, theirs = _codes(*tags)
                for at, near in strips(a, b):
                    end = at + len(near)
                    near[own[at:end, None] == row_ids[None, :]] = -np.inf
                    if rule:
                        same = mine[at:end, None] == theirs[None, :]
                        near[~same if rule == "within" else same] = -np.inf
                    bar = np.full(len(near), -2.0)
                    if near.shape[1] > k:
                        bar = np.maximum(bar, -np.partition(-near, k - 1, axis=1)[:, k - 1] - 2 * SLACK)
                    which, chosen = np.nonzero(near >= bar[:, None])
                    similar = cosines(a[which + at], b[chosen])
                    order = np.lexsort((row_ids[chosen], -similar, which))
                    which, chosen, similar = which[order], chosen[order], similar[order]
                    first = np.arange(which.size) - np.searchsorted(which, which) < k
                    columns = [asked.take(pa.array(which[first] + at)), ids.take(pa.array(chosen[first])), pa.array(similar[first])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "similarity"])

    return run


#: Rows of a group that asks for its neighbours in one task; a task is not started for fewer than FEW.
ASKING = 1 << 17
FEW = 1024


def neighbours(rows: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest others of every row (id, v) by rounded cosine, then by id; least: none below it.

    Exact. Rows are dealt to groups that ask, and lists of all rows pass by
    each group; a task keeps its group's vectors and the best that they have
    found so far, so a row is sent once to each group, and what comes out is
    the result. Products grow with the square of the rows.
    """
    ship_package(rows.sparkSession)
    n, width = rows.count(), width_of(rows)
    groups = max(1, -(-n // ASKING), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FEW)))
    lists = cut(lists_of_all(rows, max(1, -(-n // LIST)), width))
    asking = lists_of_all(rows, groups * max(1, -(-n // (groups * LIST))), width)
    asking = asking.select((F.col("part") % groups).alias("group"), F.lit(0).alias("passes"), "part", "ids", "flat")
    passing = lists.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("passes"), "part", "ids", "flat")
    dealt = asking.unionByName(passing).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "passes", "part")
    kind = rows.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(_neighbours(width, k, least), f"query_id {kind}, id {kind}, similarity double, rank long")


class _Asking:
    """A group's rows, and for each the best that have passed: which (of the group), ids and cosines."""

    def __init__(self, k: int, least: float | None):
        self.k, self.bar = k, -2.0 if least is None else least
        self.ids, self.units = [], []
        self.found: list[tuple] = []
        self.waiting, self.bars = 0, None

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        self.ids.append(ids)
        self.units.append(units)

    def meet(self, ids: np.ndarray, b: np.ndarray) -> None:
        if self.bars is None:
            self.ids, self.units = np.concatenate(self.ids), np.concatenate(self.units)
            self.few, self.bars = self.units.astype(np.float32), np.full(len(self.ids), self.bar)
        other = b.astype(np.float32).T
        step = max(1, STRIP // max(1, len(b)))
        for i in range(0, len(self.ids), step):
            near = self.few[i : i + step] @ other
            bars = self.bars[i : i + step] - SLACK
            open_ = bars <= self.bar - SLACK
            if len(b) > self.k + 1 and open_.any():  # the row itself may be one of the k + 1 best
                bars = np.where(open_, np.maximum(bars, -np.partition(-near, self.k, axis=1)[:, self.k] - 2 * SLACK), bars)
            at = np.flatnonzero(near >= bars[:, None].astype(np.float32) - np.float32(1e-6))
            which, chosen = at // len(b) + i, at % len(b)
            other_rows = self.ids[which] != ids[chosen]
            which, chosen = which[other_rows], chosen[other_rows]
            similar = cosines(self.units[which], b[chosen])
            good = similar >= self.bars[which]
            self.found.append((which[good], ids[chosen[good]], similar[good]))
            self.waiting += int(good.sum())
        if self.waiting > self.k * max(len(self.ids) // 2, 1 << 12):
            self.best()

    def best(self) -> tuple:
        which, ids, similar = (np.concatenate(c) for c in zip(*self.found)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -similar, which))
        which, ids, similar = which[order], ids[order], similar[order]
        place = np.arange(which.size) - np.searchsorted(which, which)
        first = place < self.k
        last = place == self.k - 1
        if self.bars is not None:
            self.bars[which[last]] = similar[last]
        self.found, self.waiting = [(which[first], ids[first], similar[first])], 0
        return which[first], ids[first], similar[first], place[first] + 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        which, ids, similar, rank = self.best()
        for s in range(0, which.size, 1 << 16):
            columns = [self.ids[which[s : s + (1 << 16)]], *[c[s : s + (1 << 16)] for c in (ids, similar, rank)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "similarity", "rank"])


def _neighbours(width: int, k: int, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asking = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now, passes = batch.column("group")[i].as_py(), batch.column("passes")[i].as_py()
                if now != group:
                    if asking is not None:
                        yield from asking.rows()
                    group, asking = now, _Asking(k, least)
                ids, m = batch.column("ids")[i].values.to_numpy(zero_copy_only=False), units(batch.column("flat")[i], width)
                if not passes:
                    asking.add(ids, m)
                elif asking.ids is not None and len(asking.ids):
                    asking.meet(ids, m)
        if asking is not None:
            yield from asking.rows()

    return run


def _codes(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of both as numbers, equal ones as equal numbers; a null equals nothing."""
    both = pa.concat_arrays([x, y]).dictionary_encode().indices
    codes = both.fill_null(-1).to_numpy(zero_copy_only=False)
    one, two = codes[: len(x)], codes[len(x) :]
    return one, np.where(two < 0, -2, two)


def _signal_pairs(width: int, signals: dict[str, float], cosine: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = not batch.column("part_y")[i].is_valid or batch.column("part_y")[i].as_py() == batch.column("part")[i].as_py()
                of = lambda c: batch.column(c if own else f"{c}_y")[i]  # noqa: B023, E731
                a = units(batch.column("flat")[i], width)
                b = a if own else units(of("flat"), width)
                one, two = batch.column("ids")[i].values.to_numpy(zero_copy_only=False), of("ids").values.to_numpy(zero_copy_only=False)
                base = batch.column("base")[i].values.to_numpy(zero_copy_only=False)
                codes = {s: _codes(batch.column(s)[i].values, of(s).values) for s in ("key", *signals)}
                for at, near in strips(a, b):
                    sums = near * np.float32(cosine) + base[at : at + len(near), None].astype(np.float32)
                    for s, weight in signals.items():
                        sums += np.float32(weight) * (codes[s][0][at : at + len(near), None] == codes[s][1][None, :])
                    x, y = np.nonzero((sums >= least - SLACK) & (codes["key"][0][at : at + len(near), None] == codes["key"][1][None, :]))
                    x += at
                    good = x < y if own else one[x] != two[y]
                    good &= one[x] != two[y]
                    x, y = x[good], y[good]
                    p, q = one[x], two[y]
                    weights = [pa.array(np.where(codes[s][0][x] == codes[s][1][y], w, 0.0)) for s, w in signals.items()]
                    columns = [pa.array(np.where(p < q, p, q)), pa.array(np.where(p < q, q, p)), pa.array(base[x]), pa.array(cosines(a[x], b[y])), *weights]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "base", "similarity", *signals])

    return run
