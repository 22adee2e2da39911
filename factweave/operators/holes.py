"""Triangles by degree ordering, clustering of nodes, and structural holes by constraint."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .graph import written

#: Links that one task keeps, about; members of lists that it writes out at once.
LINKS = 1 << 22
STRIP = 1 << 18


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, w: each two linked nodes once, a < b, with the sum of their edges' weights; loops are left out."""
    both = edges.filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return both.agg(F.sum("weight").alias("w"))


def triangles(pairs: DataFrame) -> DataFrame:
    """x, y, z of each three nodes that are all linked (pairs: a, b), each once.

    Every edge points from its end of lower degree to the other, equal degrees
    by id, so that no node, a hub either, has more outgoing edges than about
    the square root of all edges; only two outgoing edges of a node meet.
    """
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    degree = ends.groupBy("node").agg(F.count("*").alias("d"))
    d = lambda c: degree.select(F.col("node").alias(c), F.struct("d", "node").alias(f"d_{c}"))
    ranked = pairs.select("a", "b").join(d("a"), "a").join(d("b"), "b")
    up = F.col("d_a") < F.col("d_b")
    out = written(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high")))
    wedge = out.select("low", F.col("high").alias("y")).join(out.select("low", F.col("high").alias("z")), "low").filter("y < z")
    closed = pairs.select(F.col("a").alias("y"), F.col("b").alias("z"))
    return wedge.join(closed, ["y", "z"]).select(F.col("low").alias("x"), "y", "z")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(start - (ends - size), size)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """block, step, and side, node, size, others, ps of its lists, of rows sorted by block and step; the rows of a step are put together over batches."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        block, step, side, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        if not block.size:
            continue
        ends = batch.column(4).offsets.to_numpy()
        ends = ends - ends[0]
        others, ps = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (4, 5))
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(step) != 0)) + 1).tolist(), block.size]
        for s, e in zip(cuts, cuts[1:]):
            now = (int(block[s]), int(step[s]))
            if key is not None and now != key:
                yield (*key, *(np.concatenate(c) for c in zip(*held)))
                held = []
            key = now
            held.append((side[s:e], node[s:e], np.diff(ends[s : e + 1]), others[ends[s] : ends[e]], ps[ends[s] : ends[e]]))
    if held:
        yield (*key, *(np.concatenate(c) for c in zip(*held)))


class _Lists:
    """The lists of ``nodes`` in a step: where each begins, its size, the places of its members among ``qs``, and their values."""

    def __init__(self, nodes, qs, mine, node, size, others, ps):
        at = np.minimum(np.searchsorted(nodes, node), nodes.size - 1)
        rows = np.flatnonzero(mine & (nodes[at] == node))
        idx = _ranges((np.cumsum(size) - size)[rows], size[rows])
        owner, others = np.repeat(at[rows], size[rows]), others[idx]
        place = np.minimum(np.searchsorted(qs, others), qs.size - 1)
        known = qs[place] == others
        owner, self.place, self.value = owner[known], place[known], ps[idx][known]
        self.size = np.bincount(owner, minlength=nodes.size)
        self.start = np.cumsum(self.size) - self.size
        self.owner, self.qs = owner, qs.size

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys (a node's place times qs, and a member's) are in the lists, and their values."""
        own = self.owner * self.qs + self.place
        at = np.minimum(np.searchsorted(own, keys), own.size - 1)
        hit = np.flatnonzero(own[at] == keys)
        return hit, self.value[at[hit]]


class _Links:
    """A block's own links (u, v), and what has been summed over the common neighbours that have passed."""

    def __init__(self, side, node, size, others, ps):
        i = np.repeat(node, size)
        kept = (np.repeat(side, size) != 3) | (i < others)
        self.us, self.u = np.unique(i[kept], return_inverse=True)
        self.vs, self.v = np.unique(others[kept], return_inverse=True)
        self.p = ps[kept]
        self.more, self.common = np.zeros(self.p.size), np.zeros(self.p.size, np.int64)

    def meet(self, side, node, size, others, ps) -> None:
        """Sums over the neighbours of a step; side 1 has lists of u, 2 of v, 3 of both, 0 factors of the neighbours."""
        factors = np.repeat(side == 0, size)
        qs = others[factors] if factors.any() else np.unique(others[np.repeat((side & 1) > 0, size)])
        if not qs.size or not self.p.size:
            return
        left = _Lists(self.us, qs, (side & 1) > 0, node, size, others, ps)
        right = _Lists(self.vs, qs, (side & 2) > 0, node, size, others, ps)
        if factors.any():
            right.value = right.value * ps[factors][right.place]
        a, b = left.size[self.u], right.size[self.v]
        live = np.flatnonzero((a > 0) & (b > 0))
        few = b[live] > 8 * a[live]  # of two lists the short one is looked up in the long one
        self._through(live[few], self.u, left, self.v, right)
        self._through(live[~few], self.v, right, self.u, left)

    def _through(self, links, x, of_x, y, of_y) -> None:
        """Lists of x are written out, about STRIP members at once, and looked up in those of y."""
        ends = np.cumsum(of_x.size[x[links]])
        s = 0
        while s < links.size:
            t = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + STRIP, "right")))
            e, s = links[s:t], t
            size, own = of_x.size[x[e]], y[e]
            idx = _ranges(of_x.start[x[e]], size)
            changes = np.concatenate([[True], own[1:] != own[:-1]])
            rows = own[changes]
            if rows.size * of_y.qs <= 4 * idx.size + (1 << 16):
                table = np.zeros(rows.size * of_y.qs)
                k = _ranges(of_y.start[rows], of_y.size[rows])
                table[np.repeat(np.arange(rows.size) * of_y.qs, of_y.size[rows]) + of_y.place[k]] = of_y.value[k]
                got = table[np.repeat((np.cumsum(changes) - 1) * of_y.qs, size) + of_x.place[idx]]
                hit = np.flatnonzero(got)
                value = got[hit]
            else:
                hit, value = of_y.find(np.repeat(own * of_y.qs, size) + of_x.place[idx])
            who = np.searchsorted(np.cumsum(size), hit, "right")
            self.more[e] += np.bincount(who, value * of_x.value[idx[hit]], e.size)
            self.common[e] += np.bincount(who, minlength=e.size)

    def found(self) -> Iterator[pa.RecordBatch]:
        """The links whose ends have common neighbours."""
        seen = np.flatnonzero(self.common)
        for s in range(0, seen.size, 1 << 16):
            at = seen[s : s + (1 << 16)]
            columns = [self.us[self.u[at]], self.vs[self.v[at]], self.more[at], self.common[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "more", "common"])

    def sums(self) -> Iterator[pa.RecordBatch]:
        """For each end of the links how many it has here, their common neighbours, and the squares of what reaches the other end."""
        reach = (self.p + self.more) ** 2
        for nodes, at in ((self.us, self.u), (self.vs, self.v)):
            n, twice = np.bincount(at, minlength=nodes.size), np.bincount(at, self.common, nodes.size).astype(np.int64)
            squares = np.bincount(at, reach, nodes.size)
            for s in range(0, nodes.size, 1 << 16):
                columns = [c[s : s + (1 << 16)] for c in (nodes, n, twice, squares)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "n", "twice", "squares"])


def _through_blocks(what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, links = None, None
        for b, step, *lists in _steps(batches):
            if b != block:
                if links is not None:
                    yield from getattr(links, what)()
                block, links = b, None
            if step < 0:  # the block's own links come first
                links = _Links(*lists)
            elif links is not None:
                links.meet(*lists)
        if links is not None:
            yield from getattr(links, what)()

    return run


def _groups(spark, links: int) -> tuple[int, int]:
    """In how many groups nodes are dealt, and in how many steps each group passes by.

    A block, which is two groups, has about LINKS links, fewer where there would
    be less of them than tasks can run at once; so has what passes in a step.
    """
    several = min(8, next(b for b in range(1, 1 << 16) if b * (b + 1) >= 4 * spark.sparkContext.defaultParallelism))
    groups = max(1, math.ceil((2 * links / LINKS) ** 0.5), min(several, math.ceil((2 * links / max(1, LINKS >> 6)) ** 0.5)))
    return groups, max(1, math.ceil(8 * links / (groups * groups * LINKS)))


def _lists_of(links: DataFrame, node: str, other: str, value: str, slices: int) -> DataFrame:
    """node, slice, others, ps: a node's links as one list for each slice of the other ends."""
    step = F.pmod(F.xxhash64(other), F.lit(slices)).cast("int").alias("slice")
    own = links.groupBy(F.col(node).cast("long").alias("node"), step).agg(F.sort_array(F.collect_list(F.struct(F.col(other).cast("long").alias("o"), F.col(value).cast("double").alias("p")))).alias("x"))
    return own.select("node", "slice", F.col("x.o").alias("others"), F.col("x.p").alias("ps"))


def _sent(lists: DataFrame, to) -> DataFrame:
    return lists.select(F.explode(to).alias("t"), "node", "others", "ps").select("t.block", "t.step", "t.side", "node", "others", "ps")


def _met(rows: DataFrame, groups: int, what: str, schema: str) -> DataFrame:
    dealt = rows.repartitionById(groups * groups, F.col("block")).sortWithinPartitions("block", "step", "node")
    return dealt.mapInArrow(_through_blocks(what), schema)


def _to(block, step, side):
    return F.struct(block.cast("int").alias("block"), step.cast("int").alias("step"), side.cast("int").alias("side"))


def through_common(share: DataFrame) -> DataFrame:
    """i, j, more, common of the links (i, j) of share (i, j, p above zero, in both directions) whose ends have common neighbours q.

    more is the sum of p_iq * p_qj. Nodes (longs) are dealt to groups, and each
    two groups are a block. A task keeps the links from one group to the other,
    and the lists of both groups' neighbours pass by, slice by slice; so a list
    is sent to as many blocks as there are groups, whatever the order of ids,
    and no triangles or pairs of links are listed.
    """
    spark = share.sparkSession
    ship_package(spark)
    share = written(share)
    groups, steps = _groups(spark, -(-share.count() // 2))
    own, to = F.pmod(F.xxhash64("node"), F.lit(groups)), F.pmod(F.col("slice"), F.lit(groups))
    each = F.sequence(F.lit(0), F.lit(groups - 1))
    left = _sent(written(_lists_of(share, "i", "j", "p", groups * steps)), F.concat(F.array(_to(own * groups + to, F.lit(-1), F.lit(1))), F.transform(each, lambda g: _to(own * groups + g, F.col("slice"), F.lit(1)))))
    right = _sent(_lists_of(share, "j", "i", "p", groups * steps), F.transform(each, lambda g: _to(g * groups + own, F.col("slice"), F.lit(2))))
    return _met(left.unionAll(right), groups, "found", "i long, j long, more double, common long")


def structural_holes(edges: DataFrame) -> DataFrame:
    """node, neighbours, triangles, clustering, constraint (Burt's) of the undirected graph of edges (src, dst, weight above zero).

    A node's constraint is the sum, over its neighbours j, of the square of its
    share with j plus what reaches j through common neighbours: the lower it
    is, the more the node stands between parts that are not linked. What goes
    through common neighbours is summed block by block as in through_common.
    Weights are the same from both ends, so each link is in one block, a list
    serves both of a block's groups, and tasks give sums for nodes, not links.
    """
    spark = edges.sparkSession
    ship_package(spark)
    pairs = written(undirected(edges))
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionAll(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))
    groups, steps = _groups(spark, pairs.count())
    total = written(both.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("total")))
    lists = written(_lists_of(both, "i", "j", "w", groups * steps))
    own, to = F.pmod(F.xxhash64("node"), F.lit(groups)), F.pmod(F.col("slice"), F.lit(groups))
    each = F.sequence(F.lit(0), F.lit(groups - 1))
    blocks = F.array(*[_to(F.lit(p * groups + q), F.pmod(F.xxhash64("node"), F.lit(groups * steps)), F.lit(0)) for p in range(groups) for q in range(p, groups)])
    side = lambda g: F.when(g == own, 3).when(own < g, 1).otherwise(2)
    kept = F.filter(F.array(_to(own * groups + to, F.lit(-1), F.when(own == to, 3).otherwise(1))), lambda x: own <= to)
    passing = F.transform(each, lambda g: _to(F.least(g, own) * groups + F.greatest(g, own), F.col("slice"), side(g)))
    factors = total.select(F.col("node").cast("long").alias("node"), F.array(F.col("node").cast("long")).alias("others"), F.array(1 / F.col("total")).alias("ps"))
    found = _met(_sent(lists, F.concat(kept, passing)).unionAll(_sent(factors, blocks)), groups, "sums", "node long, n long, twice long, squares double")
    sums = found.groupBy("node").agg(F.sum("n").alias("neighbours"), F.sum("twice").alias("twice"), F.sum("squares").alias("squares")).join(total, "node")
    n = F.col("neighbours")
    constraint = F.col("squares") / (F.col("total") * F.col("total"))
    return sums.select("node", "neighbours", F.expr("twice div 2").alias("triangles"), F.when(n > 1, F.col("twice") / (n * (n - 1))).otherwise(0.0).alias("clustering"), constraint.alias("constraint"))
