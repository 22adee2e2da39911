"""Communities by modularity: rounds of local moving, then the graph of communities, and again (Louvain).

A round works out, for every node, what its edges weigh towards each
neighbouring community and where modularity gains most, smallest community first. Of
the nodes that would gain, those move whose id and round hash to an even number,
about half, and of two single nodes only the larger id, so that neighbours don't
change places for ever. The best labels of a level
go on to the next one; at last single nodes move once more on the whole graph.
Each round is joins and aggregates on edges and nodes; no node's edges are
listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .graph import written as cut

LEAST_GAIN = 1e-9


def giant_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with the most nodes; of equal ones the one with the smallest node."""
    edges = cut(edges)
    parts = components(edges)
    largest = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = parts.join(largest, "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(inside, "src", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, w of each undirected edge in both directions; weights of edges between the same nodes add up, loops are left out."""
    one = edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("w"))
    one = one.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def modularity(both: DataFrame, labels: DataFrame) -> float:
    """Of the communities (node, community) on edges in both directions."""
    ends = both.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    own = ends.groupBy("a").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = own.agg(F.sum("inside").alias("inside"), F.sum("total").alias("m"), F.sum(F.col("total") * F.col("total")).alias("squares")).first()
    return r["inside"] / r["m"] - r["squares"] / r["m"] ** 2 if r["m"] else 0.0


def _round(both: DataFrame, state: DataFrame, m: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """What the nodes of state (node, community, k, loop) wish for, written, and the state after this round.

    own: what the node's edges weigh within its community; could: whether it would gain by moving.
    """
    totals = state.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("members"))
    full = state.join(totals, "community")
    there = full.select(F.col("node").alias("dst"), F.col("community").alias("c"), F.col("total").alias("c_total"), F.col("members").alias("c_members"))
    links = both.join(there, "dst").groupBy("src", "c", "c_total", "c_members").agg(F.sum("w").alias("inside"))
    other = F.col("c") != F.col("community")
    allowed = other & ((F.col("members") > 1) | (F.col("c_members") > 1) | (F.col("c") < F.col("community")))
    value = F.round(F.col("inside") - F.col("k") * F.col("c_total") / m, 9)
    best = full.join(links, full["node"] == links["src"], "left").groupBy("node", "community", "k", "loop", "total").agg(
        F.sum(F.when(F.col("c") == F.col("community"), F.col("inside")).otherwise(0.0)).alias("own"),
        F.min(F.when(allowed, F.struct((-value).alias("v"), F.col("c").alias("c")))).alias("best"),
    )
    gain = F.round(-F.col("best.v") - (F.col("own") - F.col("k") * (F.col("total") - F.col("k")) / m), 9)
    could = F.coalesce(gain > LEAST_GAIN, F.lit(False))
    wish = cut(best.select("node", "community", "k", "loop", (F.col("own") + 2 * F.col("loop")).alias("own"), F.col("best.c").alias("to"), could.alias("could")))
    moves = F.col("could") & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
    return wish, wish.select("node", F.when(moves, F.col("to")).otherwise(F.col("community")).alias("community"), "k", "loop")


def local_moving(both: DataFrame, state: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """The best state that the rounds come to, and its modularity. state: node, community, k (degree), loop (weight within)."""
    m = state.agg(F.sum("k")).first()[0] or 0.0
    best, best_q, since = state, -1.0, 0
    if not m:
        return best, 0.0
    for turn in range(rounds):
        wish, after = _round(both, state, m, turn)
        sums = wish.groupBy("community").agg(F.sum("own").alias("own"), F.sum("k").alias("k"), F.count_if("could").alias("could"))
        r = sums.agg((F.sum("own") / m - F.sum(F.col("k") * F.col("k")) / (m * m)).alias("q"), F.sum("could").alias("could")).first()
        if r["q"] > best_q + LEAST_GAIN:
            best, best_q, since = wish.select("node", "community", "k", "loop"), r["q"], 0
        else:
            since += 1
        if not r["could"] or since > 2:
            break
        state = after
    return best, best_q


def _up(whole: DataFrame, base: DataFrame, member: DataFrame, rounds: int, levels: int) -> tuple[DataFrame, float]:
    """Moves the communities of member as nodes of their own graph, and theirs, until none moves; the communities of nodes then, and their modularity."""
    both, nodes, many, q = whole, base, base.count(), -1.0
    labels = member.select("node", F.col("community").alias("new"))
    for _ in range(levels):
        ends = both.join(labels.select(F.col("node").alias("src"), F.col("new").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("new").alias("b")), "dst")
        ends = cut(ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        inside = ends.filter("src = dst").select(F.col("src").alias("node"), (F.col("w") / 2).alias("more"))
        fewer = nodes.join(labels, "node").groupBy(F.col("new").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        nodes = cut(fewer.join(inside, "node", "left").select("node", "k", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop")))
        both, before = ends.filter("src != dst"), many
        many = nodes.count()
        if many == before:
            break
        state, q = local_moving(both, nodes.select("node", F.col("node").alias("community"), "k", "loop"), rounds)
        labels = state.select("node", F.col("community").alias("new"))
        member = cut(member.join(labels.withColumnRenamed("node", "community"), "community").select("node", F.col("new").alias("community")))
    return member, q


def louvain(edges: DataFrame, rounds: int = 40, levels: int = 6, passes: int = 1) -> DataFrame:
    """node, community: communities of the undirected graph, named by their smallest node. edges: src, dst, weight above zero.

    Loops are left out; nodes without another edge have no row. The result is
    the same in every run. rounds, levels and passes bound the work: rounds of
    a level end when no node gains by moving, levels when no community does;
    a pass starts with single nodes in the communities of the one before, and
    the best communities that were seen count.
    """
    whole = cut(both_ways(edges))
    base = cut(whole.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("loop", F.lit(0.0)))
    state, best_q = local_moving(whole, base.select("node", F.col("node").alias("community"), "k", "loop"), rounds)
    best = state.select("node", "community")
    for _ in range(passes):
        member, _ = _up(whole, base, best, rounds, levels)
        state, q = local_moving(whole, base.join(member, "node").select("node", "community", "k", "loop"), rounds)
        if q <= best_q + LEAST_GAIN:
            break
        best, best_q = cut(state.select("node", "community")), q
    names = best.groupBy("community").agg(F.min("node").alias("first"))
    return best.join(names, "community").select("node", F.col("first").alias("community"))
