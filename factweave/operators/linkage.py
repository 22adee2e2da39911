"""Agglomerative clusters by complete linkage, merging reciprocal nearest neighbours at falling bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import blocks
from .blocks import SLACK, cosines, strips, units
from .graph import cut, written
from .index import plain_rows

#: Links of the first level for each cluster (each level may have twice as many), and links that any level may have.
LINKS = 16
FEW = 1 << 19
#: A level other than the last may leave this share of its links to the next one, which saves it many rounds with few merges.
REST = 1 / 16
#: Clusters on which a level's bar is chosen; most members of a cluster that a list holds as one group; pairs of groups looked at together.
TRIED = 256
GROUP = 256
PIECE = 1 << 13


def complete_linkage(links: DataFrame, rest: float = 0) -> DataFrame:
    """old, new: the merges, each cluster that is no more with the one that took it in. links: a, b, s of all pairs of clusters over a bar, each once, a < b.

    Two clusters are as similar as their least similar members. With all links
    over a bar at hand, that is the least link between them, if every pair of
    members has one; a pair of clusters that lacks one can't ever merge over
    the bar, so it is dropped. In each round every cluster picks its best
    partner (most similar, then smallest ids) and those that pick one another
    merge, which gives the clusters that merging the best pair of all, one by
    one, gives. The best link of all is always picked by both ends, so rounds
    end. A round is one table: what links are left, and (without s) its merges.
    Any round may be the last for now: links that are left belong to pairs of
    clusters that can be found again. rest: the share of the links at which it is.
    """
    one = F.lit(1).cast("long")
    now = written(links.select("a", "b", "s", one.alias("pairs"), one.alias("n_a"), one.alias("n_b")))
    spark, rounds = links.sparkSession, []
    live = now
    left = first = live.count()
    while left > rest * first:
        choice = F.struct((-F.col("s")).alias("s"), "a", "b", (F.col("n_a") + F.col("n_b")).alias("n"))
        best = live.select(F.explode(F.array("a", "b")).alias("x"), choice.alias("c")).groupBy("x").agg(F.min("c").alias("c"))
        agreed = best.groupBy("c.a", "c.b", "c.n").agg(F.count("*").alias("votes")).filter("votes = 2")
        moved = agreed.select(F.explode(F.array("a", "b")).alias("was"), F.col("a").alias("is"), "n")
        of = lambda c: moved.select(F.col("was").alias(c), F.col("is").alias(f"is_{c}"), F.col("n").alias(f"m_{c}"))  # noqa: B023, E731
        both = live.join(of("a"), "a", "left").join(of("b"), "b", "left")
        x, y, n_x, n_y = F.coalesce("is_a", "a"), F.coalesce("is_b", "b"), F.coalesce("m_a", "n_a"), F.coalesce("m_b", "n_b")
        both = both.select(F.least(x, y).alias("x"), F.when(x == y, F.col("b")).otherwise(F.greatest(x, y)).alias("y"), (x == y).alias("merged"), "s", "pairs", F.when(x <= y, n_x).otherwise(n_y).alias("n_x"), F.when(x <= y, n_y).otherwise(n_x).alias("n_y"))
        both = both.groupBy("x", "y", "merged").agg(F.min("s").alias("s"), F.sum("pairs").alias("pairs"), F.max("n_x").alias("n_a"), F.max("n_y").alias("n_b"))
        both = both.filter("merged or pairs = n_a * n_b")
        now = written(both.select(F.col("x").alias("a"), F.col("y").alias("b"), F.when(~F.col("merged"), F.col("s")).alias("s"), "pairs", "n_a", "n_b"))
        rounds.append(now.filter("s is null").select(F.col("b").alias("old"), F.col("a").alias("new")))
        live = now.filter("s is not null")
        left = live.count()
    if not rounds:
        kind = links.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"old {kind}, new {kind}")
    merges = rounds[0]
    for more in rounds[1:]:
        merges = merges.unionAll(more)
    return last_of(written(merges))


def last_of(merges: DataFrame) -> DataFrame:
    """old, new with the cluster that took the old one in at last: each names what its own one is in, until none is in another."""
    while True:
        above = merges.select(F.col("old").alias("new"), F.col("new").alias("above"))
        merges = written(merges.select("old", "new").join(above, "new", "left").select("old", F.coalesce("above", "new").alias("new"), F.col("above").isNotNull().alias("went")))
        if merges.filter("went").isEmpty():
            return merges.select("old", "new")


def dealt(members: DataFrame, width: int, size: int, group: int) -> DataFrame:
    """part, clusters, groups, whole, flat: members (id, v, cluster, n) in lists of about ``size`` by cluster; of large clusters groups are dealt apart."""
    own = members.withColumn("group", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / group)).cast("int"))
    rows = members.count()
    parts = max(1, -(-rows // size), min(8, rows // 512))
    part = F.pmod(F.xxhash64("cluster", "group"), F.lit(parts)).cast("int")
    x = F.struct("cluster", "group", "id", "n", blocks.of_width(F.col("v"), width).alias("v"))
    lists = own.select(part.alias("part"), x.alias("x")).groupBy("part").agg(F.sort_array(F.collect_list("x")).alias("x"))
    lists = lists.select("part", F.col("x.cluster").alias("clusters"), F.col("x.group").alias("groups"), F.col("x.n").alias("whole"), F.flatten("x.v").alias("flat"))
    return cut(lists.repartitionById(parts, F.col("part")))


def _list(batch: pa.RecordBatch, i: int, end: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a list: its unit rows, where its groups begin (and the last one ends), and of each group its cluster and how many rows that has in all."""
    rows = units(batch.column(f"flat{end}")[i], width)
    clusters, groups, whole = (batch.column(f"{c}{end}")[i].values.to_numpy(zero_copy_only=False) for c in ("clusters", "groups", "whole"))
    starts = np.flatnonzero(np.concatenate([[True], (clusters[1:] != clusters[:-1]) | (groups[1:] != groups[:-1])]))
    return rows, np.append(starts, len(rows)), clusters[starts], whole[starts]


def _least(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """x, y, the least cosine and the number of pairs of rows, for those pairs of groups of which all pairs of rows have a cosine of ``least``."""
    n, pairs = np.diff(bt)[y], np.diff(at)[x] * np.diff(bt)[y]
    s, seen = np.full(len(x), np.inf), 0
    for some in (1, 4, 16):  # most fail at one of their first pairs
        k = np.minimum(pairs, some) - np.minimum(pairs, seen)
        who = np.repeat(np.arange(len(x)), k)
        which = np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k) + seen
        np.minimum.at(s, who, cosines(a[at[x[who]] + which // n[who]], b[bt[y[who]] + which % n[who]]))
        x, y, n, pairs, s = (z[s >= least] for z in (x, y, n, pairs, s))
        seen = some
    for i in np.flatnonzero(pairs > seen).tolist():
        one, two = a[at[x[i]] : at[x[i] + 1]], b[bt[y[i]] : bt[y[i] + 1]]
        near = one.astype(np.float32) @ two.astype(np.float32).T
        low = near.min()
        s[i] = -np.inf
        if low >= least - SLACK:
            p, q = np.nonzero(near <= low + 2 * SLACK)
            s[i] = cosines(one[p], two[q]).min()
    good = s >= least
    return x[good], y[good], s[good], pairs[good]


def _links(width: int, least: float, once: bool):
    """For two lists and the same of the second: a, b, s, pairs, n_a, n_b of their groups of different clusters; once: every two lists meet once, else both ways.

    The first rows of all groups meet as a matrix product; for those near enough, all their rows do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, at, one, n_a = _list(batch, i, "", width)
                b, bt, two, n_b = _list(batch, i, "_y", width)
                own = once and batch.column("part")[i].as_py() == batch.column("part_y")[i].as_py()
                for begin, near in strips(a[at[:-1]], b[bt[:-1]]):
                    found = np.nonzero(near >= least - SLACK)
                    for j in range(0, len(found[0]), PIECE):
                        x, y = found[0][j : j + PIECE] + begin, found[1][j : j + PIECE]
                        wanted = (one[x] != two[y]) & (x < y) if own else one[x] != two[y]
                        x, y, s, pairs = _least(a, at, b, bt, x[wanted], y[wanted], least)
                        p, q, n_p, n_q = one[x], two[y], n_a[x], n_b[y]
                        turn = once & (p > q)
                        columns = [np.where(turn, q, p), np.where(turn, p, q), s, pairs, np.where(turn, n_q, n_p), np.where(turn, n_p, n_q)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "s", "pairs", "n_a", "n_b"])

    return run


def met(lists: DataFrame, other: DataFrame, how: Column, width: int, least: float, once: bool, kind: str) -> DataFrame:
    """a, b, s of the pairs of clusters of which all pairs of members have a cosine of ``least`` at least."""
    second, _ = blocks.twice(other)
    found = lists.join(second, how).mapInArrow(_links(width, least, once), f"a {kind}, b {kind}, s double, pairs long, n_a long, n_b long")
    found = found.groupBy("a", "b").agg(F.min("s").alias("s"), F.sum("pairs").alias("pairs"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return found.filter("pairs = n_a * n_b").select("a", "b", "s")


def bar_of(members: DataFrame, lists: DataFrame, clusters: int, width: int, least: float, links: int, size: int, group: int) -> float:
    """The similarity that about ``links`` pairs of clusters have, judged by those of TRIED clusters with all; ``least`` if fewer have that.

    Some pair has the bar itself, so clusters merge at every level.
    """
    if clusters * (clusters - 1) // 2 <= links:
        return least
    few = members.select("cluster").distinct().orderBy(F.xxhash64("cluster"), "cluster").limit(TRIED)
    some = dealt(cut(members.join(few, "cluster", "left_semi")), width, size, group)
    found = met(some, lists, F.lit(True), width, least, False, members.schema["cluster"].dataType.simpleString())
    wanted = max(1, 2 * links * min(TRIED, clusters) // clusters)
    n, low = found.select("s").orderBy(F.desc("s")).limit(wanted).agg(F.count("*"), F.min("s")).first()
    return low if n == wanted else least


def clusters_by_levels(rows: DataFrame, least: float, links: int = LINKS, few: int = FEW, size: int = blocks.LIST, group: int = GROUP) -> DataFrame:
    """id, cluster (its smallest id) of rows (id, v) by complete linkage with a cosine of ``least`` at least.

    What merges at a similarity over a bar depends on links over that bar only.
    So clusters merge at a high bar first, which few links have, and these
    clusters then meet at the next one: two of them are linked if all their
    members are, which again few are. So no level has many more than ``links``
    links for each cluster (``few`` in all; twice as many at each level), where
    the rows' own links at ``least`` grow with the square of the rows.
    """
    if least <= 0:
        raise ValueError("least must be above zero")
    ship_package(rows.sparkSession)
    rows = cut(rows.select("id", "v"))
    width, kind = blocks.width_of(rows), rows.schema["id"].dataType.simpleString()
    members = rows.withColumn("cluster", F.col("id")).withColumn("n", F.lit(1).cast("long"))
    while True:
        clusters = members.select("cluster").distinct().count()
        lists = dealt(members, width, size, group)
        bar = max(least, bar_of(members, lists, clusters, width, least, max(few, links * clusters), size, group))
        merges = complete_linkage(met(lists, lists, F.col("part") <= F.col("part_y"), width, bar, True, kind), REST if bar > least else 0)
        now = members.join(merges, members["cluster"] == merges["old"], "left").select("id", F.coalesce("new", "cluster").alias("cluster"))
        if bar <= least:
            return now
        now = written(now)
        sizes = now.groupBy("cluster").agg(F.count("*").alias("n"))
        members = written(rows.join(now, "id").join(sizes, "cluster").select("id", "v", "cluster", "n"))
        links, few = 2 * links, 2 * few


def linkage_clusters(vectors: DataFrame, id_col: str, vector_col: str, least: float, **how: int) -> DataFrame:
    """id, cluster of every row with a vector: any two rows of a cluster have a cosine of ``least`` at least.

    Equal vectors are one node; rows that repeat an id count once; a cluster's
    name is its smallest id. Vectors that can't be compared stay alone. how:
    the bounds of clusters_by_levels.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(vector_col).alias("v"))
    own = cut(rows.groupBy("v").agg(F.min("id").alias("node")))
    found = clusters_by_levels(plain_rows(own, "node", "v", None), least, **how).withColumnRenamed("id", "node")
    named = own.join(found, "node", "left").select("v", F.coalesce("cluster", "node").alias("cluster"))
    return rows.join(named, "v").select("id", "cluster")
