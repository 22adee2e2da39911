"""Communities, centrality and clusters on edge tables and vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut, degrees, pagerank


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """node, community: every round each node takes the label that its edges (both ways) weigh most for, the smallest of equal ones.

    All nodes move at once, so the result is the same in every run; after the
    given rounds the labels stand. Weights are summed by node and label with a
    map side before the best label of a node is chosen.
    """
    both = cut(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "community").agg(F.round(F.sum("weight"), 9).alias("votes"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("community").alias("c"))).alias("b"))
        labels = cut(best.select(F.col("src").alias("node"), F.col("b.c").alias("community")))
    return labels


def betweenness(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """node, betweenness: how much of the shortest paths from the sources (a stated set, column node) passes through, up to ``depth`` steps.

    Paths are counted forward level by level; what hangs on a node is summed
    backward. Ends don't count. Nodes that no path passes have no row.
    """
    steps = cut(edges.filter("src != dst").select("src", "dst").distinct())
    seen = cut(sources.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")).distinct())
    level = seen
    for d in range(1, depth + 1):
        new = level.join(steps, level["node"] == steps["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut(new.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(d).alias("d"), "paths"))
        seen = cut(seen.unionByName(level))
    hung = seen.filter(F.col("d") == depth).select("s", "node", F.lit(0.0).alias("delta"))
    out = hung
    for d in range(depth, 0, -1):
        below = seen.filter(F.col("d") == d).join(hung, ["s", "node"]).select("s", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("paths")).alias("each"))
        above = seen.filter(F.col("d") == d - 1)
        gained = above.join(steps, above["node"] == steps["src"]).join(below, ["s", "dst"]).groupBy("s", "node").agg(F.sum(F.col("paths") * F.col("each")).alias("delta"))
        hung = cut(above.select("s", "node").join(gained, ["s", "node"], "left").select("s", "node", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        out = out.unionByName(hung)
    return out.filter("s != node and delta > 0").groupBy("node").agg(F.sum("delta").alias("betweenness"))


def centrality(edges: DataFrame, sources: DataFrame, rounds: int, depth: int) -> DataFrame:
    """node, pagerank, degree, betweenness, each as a share of its largest, and score: 0.4, 0.3 and 0.3 of them."""
    every = degrees(edges).select("node", (F.col("out_degree") + F.col("in_degree")).cast("double").alias("degree"))
    both = every.join(pagerank(edges, rounds).withColumnRenamed("rank", "pagerank"), "node").join(betweenness(edges, sources, depth), "node", "left").fillna(0.0, ["betweenness"])
    both = cut(both)
    most = both.agg(*[F.max(c).alias(f"m_{c}") for c in ("pagerank", "degree", "betweenness")])
    share = lambda c: F.when(F.col(f"m_{c}") > 0, F.col(c) / F.col(f"m_{c}")).otherwise(0.0).alias(c)
    own = both.crossJoin(F.broadcast(most)).select("node", share("pagerank"), share("degree"), share("betweenness"))
    return own.withColumn("score", 0.4 * F.col("pagerank") + 0.3 * F.col("degree") + 0.3 * F.col("betweenness"))


def themes(vectors: DataFrame, id_col: str, vector_col: str, least: int, most: int, seed: int = 42) -> DataFrame:
    """id, theme, k: k-means with the number of clusters whose silhouette is best; of equal ones the smallest."""
    rows = vectors.select(F.col(id_col).alias("id"), array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))).alias("features"))
    best = None
    for k in range(least, most + 1):
        found = KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows)
        score = round(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(found), 9)
        if best is None or score > best[0]:
            best = (score, k, found)
    return best[2].select("id", F.col("prediction").cast("long").alias("theme"), F.lit(best[1]).cast("long").alias("k"))
