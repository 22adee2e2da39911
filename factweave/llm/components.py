"""Connected components of a graph given as edges, by large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node, itself included, to the smallest of them.

    large: only neighbours above the node move; else only those below it. The
    smallest neighbour is an aggregate with a map side, and the join with it
    can be split by key, so that a node with many neighbours loads no one task.
    """
    if large:
        ends = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = ends.join(least, "u")
    if large:
        moved = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges: u, v, of one type that can be ordered. Gives node, component: the smallest node that each can reach.

    Nodes without an edge to another node have no row. Rounds go on until the
    edges no longer change; each one is written to the shared folder, and what
    tells them apart is a count and a sum of hashes.
    """
    now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    for _ in range(rounds):
        now = materialize(_stars(_stars(now, large=True), large=False), "stars")
        new = mark(now)
        if new == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = new
    raise RuntimeError(f"components still change after {rounds} rounds")
