"""Density clusters: mutual reachability on a graph of neighbours, a minimum spanning forest, the condensed tree and its stable clusters.

The forest grows by rounds in which every component takes its shortest edge to
another one. The tree over it needs the edges in order of their lengths; they
are taken in runs of a bounded number, each in one task, which only sees the
components that its edges touch: their size, the cluster that they are, and
what that cluster has gathered. Stability is summed from below: a row counts in
its cluster from the density at which the cluster parts from its parent to that
at which the row leaves it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, written
from .graph import written as cut
from .index import build, pairs_over, search

#: Edges of the forest that one task takes in order.
EDGES_AT_ONCE = 1 << 19
#: The density at which rows at no distance leave.
DENSEST = 1e9


def mutual_reachability(neighbours: DataFrame, core: int) -> DataFrame:
    """a, b, d: the distance at which two rows count as dense together. neighbours: query_id, id, distance, rank, from every row.

    A row's core distance is that to its ``core``-th neighbour, or to its last
    one, if it has fewer; an edge is as long as the longest of both core
    distances and the distance itself.
    """
    cores = neighbours.filter(F.col("rank") <= core).groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("core"))
    of = lambda c: cores.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    both = neighbours.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return both.join(of("a"), "a").join(of("b"), "b", "left").select("a", "b", F.greatest("distance", "core_a", F.coalesce("core_b", F.lit(0.0))).alias("d"))


def spanning_forest(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """The edges (a, b, d) of the minimum spanning forest; of equal lengths the smallest ids come first."""
    edges = cut(edges.select("a", "b", "d"))
    at = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node")))
    forest = None
    for _ in range(rounds):
        ends = edges.join(at.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        edges_now = cut(ends.filter("x != y"))
        edge = F.struct("d", "a", "b")
        best = edges_now.select(F.col("x").alias("c"), edge.alias("e"), "x", "y").unionAll(edges_now.select(F.col("y").alias("c"), edge.alias("e"), "x", "y"))
        chosen = cut(best.groupBy("c").agg(F.min(F.struct("e", "x", "y")).alias("m")).select("m.e.a", "m.e.b", "m.e.d", "m.x", "m.y").distinct())
        if chosen.isEmpty():
            break
        forest = chosen.select("a", "b", "d") if forest is None else cut(forest.unionByName(chosen.select("a", "b", "d")))
        joined = components(chosen.select(F.col("x").alias("src"), F.col("y").alias("dst")))
        at = cut(at.join(joined, at["comp"] == joined["node"], "left").select(at["node"], F.coalesce("component", "comp").alias("comp")))
        edges = edges_now.select("a", "b", "d")
    else:
        raise RuntimeError(f"the forest still grows after {rounds} rounds")
    return forest if forest is not None else edges.limit(0)


STEP = "kind string, old long, comp long, size long, cluster string, gathered double, below double, parent string, birth double, stability double, chosen boolean, density double"


def _merge(least: int):
    """Edges in order (d, x, y with what the components x and y are) to rows of three kinds.

    comp: what the component ``old`` has become; joined: rows of component
    ``old``, which was no cluster, are in ``cluster``; cluster: one that has
    found its parent, with its stability and whether it is better than what is
    below it.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["d", "a", "b"], kind="stable")
        state: dict[int, list] = {}  # component: size, cluster, gathered, below, and the components of this run that are in it and in no cluster
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for side in "xy":
            for c, size, cluster, gathered, below in zip(*(frame[f"{n}_{side}"] for n in ("comp", "size", "cluster", "gathered", "below"))):
                if c not in state:
                    known = isinstance(cluster, str)
                    state[c], root[c] = [int(size), cluster if known else None, float(gathered), float(below), [] if known else [c]], c
        out, touched = [], list(state)
        for d, x, y in zip(frame["d"], frame["comp_x"], frame["comp_y"]):
            x, y = sorted((find(x), find(y)))
            density = min(DENSEST, 1.0 / d) if d > 0 else DENSEST
            a, b = state[x], state[y]
            size, loose = a[0] + b[0], a[4] + b[4]
            if a[1] is not None and b[1] is not None:
                name, below = f"of-{key[0]}-{len(out)}", 0.0
                for one in (a, b):
                    stability = one[2] - one[0] * density
                    out.append(("cluster", None, None, one[0], one[1], None, None, name, density, stability, bool(stability >= one[3]), None))
                    below += max(stability, one[3])
                new = [size, name, size * density, below, []]
            elif a[1] is None and b[1] is None and size < least:
                new = [size, None, 0.0, 0.0, loose]
            else:
                grown = a if a[1] is not None else b
                if a[1] is None and b[1] is None:  # a cluster is born
                    name, gathered, below = f"at-{x}", size * density, 0.0
                else:
                    name, gathered, below = grown[1], grown[2] + (size - grown[0]) * density, grown[3]
                out += [("joined", c, None, None, name, None, None, None, None, None, None, density) for c in loose]
                new = [size, name, gathered, below, []]
            state[x], root[y] = new, x
        for c in touched:
            own = state[find(c)]
            out.append(("comp", c, find(c), own[0], own[1], own[2], own[3], None, None, None, None, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in STEP.split(", ")])

    return run


def _steps(forest: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """node, cluster of the rows that were in one; the clusters with a parent; the components at the end (node, comp) with their state."""
    n = forest.count()
    runs = max(1, -(-n // EDGES_AT_ONCE))
    forest = cut(forest.repartitionByRange(runs, "d", "a", "b").withColumn("run", F.spark_partition_id()))
    at = cut(forest.select(F.col("a").alias("node")).union(forest.select("b")).distinct().withColumn("comp", F.col("node")))
    state, joined, clusters = None, None, None
    for i in range(runs):
        part = forest.filter(F.col("run") == i)
        x = at.select(F.col("node").alias("a"), F.col("comp").alias("comp_x"))
        y = at.select(F.col("node").alias("b"), F.col("comp").alias("comp_y"))
        ends = part.join(x, "a").join(y, "b")
        for side in "xy":
            if state is None:
                ends = ends.select("*", F.lit(1).cast("long").alias(f"size_{side}"), F.lit(None).cast("string").alias(f"cluster_{side}"), F.lit(0.0).alias(f"gathered_{side}"), F.lit(0.0).alias(f"below_{side}"))
            else:
                own = state.select(F.col("comp").alias(f"comp_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "cluster", "gathered", "below")])
                ends = ends.join(own, f"comp_{side}", "left").fillna({f"size_{side}": 1, f"gathered_{side}": 0.0, f"below_{side}": 0.0})
        said = cut(ends.groupBy("run").applyInPandas(_merge(least), STEP))
        moved = said.filter("kind = 'comp'")
        own_joined = at.join(said.filter("kind = 'joined'").select(F.col("old").alias("comp"), "cluster"), "comp").select("node", "cluster")
        joined = own_joined if joined is None else joined.unionByName(own_joined)
        joined = cut(joined)
        own_clusters = said.filter("kind = 'cluster'").select("cluster", "parent", "stability", "chosen")
        clusters = own_clusters if clusters is None else clusters.unionByName(own_clusters)
        new_state = moved.select("comp", "size", "cluster", "gathered", "below").distinct()
        if state is not None:
            new_state = new_state.unionByName(state.join(moved.select(F.col("old").alias("comp")), "comp", "left_anti"))
        state = cut(new_state)
        at = cut(at.join(moved.select("old", F.col("comp").alias("new")), at["comp"] == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp")))
    return joined, clusters, state


def density_clusters(edges: DataFrame, least: int, rounds: int = 40) -> DataFrame:
    """node, cluster: the stable clusters of at least ``least`` rows; null for noise. edges: a, b, d, one for each two nodes.

    A component of the graph that is a whole cluster counts, if there are
    several of at least that size; else the whole is no cluster. Equal lengths are taken
    in the order of their ids. Clusters are named by their smallest node.
    """
    forest = cut(spanning_forest(edges, rounds))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if forest.isEmpty():
        return nodes.withColumn("cluster", F.lit(None).cast("long"))
    joined, clusters, state = _steps(forest, least)
    several = state.filter("cluster is not null").count() > 1
    stability = F.col("gathered")  # a component parts from all others at density zero
    tops = state.filter("cluster is not null").select("cluster", F.lit(None).cast("string").alias("parent"), stability.alias("stability"), (F.lit(several) & (stability >= F.col("below"))).alias("chosen"))
    tree = cut(clusters.unionByName(tops).select("cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("top")))
    for _ in range(rounds):  # each round doubles how far up a cluster has looked; the last chosen one above it counts
        above = tree.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        tree = cut(tree.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")))
        if tree.filter("up is not null").isEmpty():
            break
    found = joined.join(tree.select("cluster", "top"), "cluster").filter("top is not null").select("node", "top")
    names = found.groupBy("top").agg(F.min("node").alias("name"))
    named = found.join(names, "top").select(F.col("node").alias("_n"), "name")
    return nodes.join(named, nodes["node"] == named["_n"], "left").select("node", F.col("name").alias("cluster"))


def centroids_of(members: DataFrame) -> DataFrame:
    """cluster, centroid (of length one), n. members: cluster, v."""
    parts = members.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    lists = parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    centre = F.transform("c", lambda p: p["m"])
    size = F.sqrt(F.aggregate(centre, F.lit(0.0), lambda s, x: s + x * x))
    return lists.withColumn("m", centre).withColumn("len", size).join(sizes, "cluster").select("cluster", F.when(F.col("len") > 0, F.transform("m", lambda x: x / F.col("len"))).otherwise(F.col("m")).alias("centroid"), "n")


def merge_alike(clusters: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """clusters (node, cluster) with those joined, under the smallest name, whose centroids (cluster, centroid) have a cosine of ``least``, or are linked by such."""
    alike = pairs_over(build(centres, "cluster", "centroid"), least)
    parts = written(components(alike.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    return clusters.join(parts.select(F.col("node").alias("_c"), "component"), F.col("cluster") == F.col("_c"), "left").select(clusters["node"], F.coalesce("component", "cluster").alias("cluster"))


def attach_noise(rows: DataFrame, clusters: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """id, cluster, attached: noise takes the cluster whose centroid is nearest, if it has a cosine of ``least``, of equal ones the smallest.

    rows: id, v; clusters: node, cluster (null for noise); centres: cluster, centroid.
    """
    both = written(rows.join(clusters, rows["id"] == clusters["node"], "left").select("id", "v", "cluster"))
    # A query's own id is left out of a search; noise asks under names that no cluster has.
    asked = both.filter("cluster is null").select((-F.col("id") - 1).alias("id"), "v", F.lit(None).cast("string").alias("tag"))
    near = search(build(centres, "cluster", "centroid"), asked, 1, None, least=least).select((-F.col("query_id") - 1).alias("_i"), F.col("id").alias("near"))
    out = both.join(near, both["id"] == near["_i"], "left")
    return out.select("id", F.coalesce("cluster", "near").alias("cluster"), F.expr("cluster is null and near is not null").alias("attached"))
