"""Graph operators on edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


#: Whether Spark removes a query's shuffle files when it ends.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder: rounds that build on one another start from its size alone.

    A checkpoint keeps the constraints of the plan that made it, and where a
    column stands under two names these double from round to round. What the
    write has shuffled goes when it ends, else the disk holds it for all rounds.
    """
    spark = df.sparkSession
    place = shared_folder(spark, "rounds")
    before = spark.conf.get(CLEANS, "false")
    spark.conf.set(CLEANS, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(CLEANS, before)
    return spark.read.schema(df.schema).parquet(place)


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """node, rank after some rounds from equal ranks; what nodes without outgoing edges hold is spread over all.

    Each node keeps its outgoing shares as one list, so a round is one pass
    over the nodes and one aggregate: a node gives its shares, and a row of its
    own, to their targets. What sinks lose goes along in the same aggregate,
    as the rank that no share carries on. Lists of a node with very many
    edges are split over several rows of that node.
    """
    parts = 1 << 16
    places = Window.partitionBy("src").orderBy("dst")
    total = F.sum("weight").over(Window.partitionBy("src"))
    out = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = out.select("src", "dst", (F.col("weight") / total).alias("share"), F.floor(F.row_number().over(places) / parts).alias("part"))
    lists = out.groupBy("src", "part").agg(F.collect_list(F.struct("dst", "share")).alias("out"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    graph = cut(nodes.join(lists, nodes["node"] == lists["src"], "left").select("node", "out", F.coalesce("part", F.lit(0)).alias("part")))
    n = graph.filter("part = 0").count()
    ranks = graph.filter("part = 0").select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        held = graph.join(ranks, "node")
        given = held.select(F.explode("out").alias("o"), "rank").select(F.col("o.dst").alias("node"), (F.col("rank") * F.col("o.share")).alias("got"))
        own = held.filter("part = 0").select("node", F.lit(0.0).alias("got"))
        sums = given.unionByName(own).groupBy("node").agg(F.sum("got").alias("got"))
        carried = held.filter("out is not null and part = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("carried"))
        both = sums.crossJoin(F.broadcast(carried))
        ranks = cut(both.select("node", ((1 - damping) / n + damping * (F.col("got") + (1 - F.col("carried")) / n)).alias("rank")))
    return ranks


def reach(edges: DataFrame, start: DataFrame, hops: int, per_hop: int | None = None) -> DataFrame:
    """node, depth: what a frontier join finds in up to ``hops`` steps, each node at its least depth.

    per_hop: a budget of new nodes for each step, the strongest edges first.
    """
    seen = cut(start.select("node", F.lit(0).cast("long").alias("depth")).distinct())
    frontier = seen
    for depth in range(1, hops + 1):
        new = edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("w"))
        new = new.join(seen, "node", "left_anti")
        if per_hop is not None:
            new = new.orderBy(F.desc("w"), "node").limit(per_hop)
        frontier = cut(new.select("node", F.lit(depth).cast("long").alias("depth")))
        seen = cut(seen.unionByName(frontier))
    return seen


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: labels are the least node.

    Each round a node takes the least label of its neighbours, and so does the
    node that is its label; then each takes its label's label. Whole trees of
    labels join at their roots, so long chains take few rounds.
    """
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy(F.col("src").alias("_n")).agg(F.min("component").alias("near"))
        own = labels.join(near, labels["node"] == near["_n"])
        roots = own.select(F.col("component").alias("node"), F.col("near").alias("component"), F.lit(None).cast(labels.schema["node"].dataType).alias("old"))
        asked = own.select("node", F.least("component", "near").alias("component"), F.col("component").alias("old")).unionAll(roots)
        moved = asked.groupBy("node").agg(F.min("component").alias("component"), F.min("old").alias("old"))
        up = moved.select(F.col("node").alias("_m"), F.col("component").alias("above"))
        jumped = written(moved.join(up, moved["component"] == up["_m"]).select("node", F.least("component", "above").alias("component"), "old"))
        changed = jumped.filter("component != old").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def compose(edges: DataFrame, discount: float = 0.9, floor: float = 0.5, hub_out: int | None = None) -> DataFrame:
    """src, dst, confidence of two-step relations that aren't edges yet: the least of both times a discount, not under a floor.

    hub_out: nodes with more outgoing edges don't pass relations on.
    """
    via = edges
    if hub_out is not None:
        hubs = edges.groupBy("src").count().filter(F.col("count") > hub_out).select("src")
        via = edges.join(hubs, "src", "left_anti")
    second = via.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("weight").alias("w2"))
    two = edges.join(second, edges["dst"] == second["mid"]).filter("src != end")
    best = two.groupBy("src", F.col("end").alias("dst")).agg(F.max(F.least("weight", "w2") * discount).alias("confidence"))
    return best.filter(F.col("confidence") >= floor).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k strongest outgoing edges."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
