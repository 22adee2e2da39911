"""The relation graph: suppliers that follow one another in an order's lines stand for linked concepts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import read
from .registry import query

EDGES_SQL = """step AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
counted AS (SELECT src, dst, count(*) AS n FROM step WHERE dst IS NOT NULL GROUP BY src, dst), top AS (SELECT max(n) AS top FROM counted),
edges AS (SELECT src, dst, n, n::DOUBLE / top AS weight FROM counted CROSS JOIN top)"""
STRONG_SQL = f"{EDGES_SQL}, strong AS (SELECT * FROM edges WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3)"


def edges(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).filter("dst is not null")
    counted = steps.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.max("n").alias("top")))).withColumn("weight", F.col("n") / F.col("top")).drop("top")


def strong(spark, sf_dir):
    return G.strongest(edges(spark, sf_dir).filter("src != dst"), 3)


@query("graph_degrees", [264], f"""WITH {EDGES_SQL}, d AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM d GROUP BY node""")
def graph_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query("graph_quality", [85, 267, 338], f"""WITH {EDGES_SQL}
SELECT count(*)::BIGINT AS edges, count(*) FILTER (WHERE src = dst)::BIGINT AS loops, count(*) FILTER (WHERE n = 1)::BIGINT AS weak,
  (SELECT count(*) FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)::BIGINT AS two_cycles, round(max(n)::DOUBLE / sum(n), 6) AS top_share FROM edges""")
def graph_quality(spark, sf_dir):
    own = edges(spark, sf_dir)
    pairs = own.filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("ways")).agg(F.count_if(F.col("ways") == 2).alias("two_cycles"))
    facts = own.agg(
        F.count("*").alias("edges"), F.count_if(F.expr("src = dst")).alias("loops"), F.count_if(F.col("n") == 1).alias("weak"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share")
    )
    return facts.crossJoin(F.broadcast(pairs))


def pagerank_sql(rounds: int) -> str:
    parts = [f"{EDGES_SQL}, t AS (SELECT src, sum(weight) AS total FROM edges GROUP BY src), s AS (SELECT src, dst, weight / total AS share FROM edges JOIN t USING (src))",
             "v AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT node, 1 / n AS rank FROM v CROSS JOIN c)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(f"r{i} AS (SELECT v.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + coalesce((SELECT sum(rank) FROM {p} WHERE node NOT IN (SELECT src FROM t)), 0) / n) AS rank "
                     f"FROM v CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM s JOIN {p} ON src = node GROUP BY dst) g ON v.node = g.dst)")
    return "WITH " + ", ".join(parts) + f" SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query("graph_pagerank", [262], pagerank_sql(5))
def graph_pagerank(spark, sf_dir):
    return G.pagerank(edges(spark, sf_dir), 5).select("node", F.round("rank", 8).alias("rank"))


@query("graph_chains", [65, 256], f"""WITH RECURSIVE {STRONG_SQL}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN strong ON src = node WHERE depth < 4)
SELECT node, min(depth)::BIGINT AS depth FROM walk GROUP BY node""")
def graph_chains(spark, sf_dir):
    """What can be reached from one node in up to four steps along strong edges."""
    return G.reach(strong(spark, sf_dir), spark.range(1, 2).withColumnRenamed("id", "node"), 4)


@query("budgeted_expansion", [129, 259], f"""WITH {EDGES_SQL}, h1 AS (SELECT dst AS node, max(weight) AS w FROM edges WHERE src = 1 AND dst <> 1 GROUP BY dst ORDER BY w DESC, node LIMIT 10),
h2 AS (SELECT dst AS node, max(weight) AS w FROM edges JOIN h1 ON src = node WHERE dst <> 1 AND dst NOT IN (SELECT node FROM h1) GROUP BY dst ORDER BY w DESC, node LIMIT 10)
SELECT 1::BIGINT AS node, 0::BIGINT AS depth UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def budgeted_expansion(spark, sf_dir):
    return G.reach(edges(spark, sf_dir), spark.range(1, 2).withColumnRenamed("id", "node"), 2, per_hop=10)


@query("graph_components", [140, 264], f"""WITH RECURSIVE {EDGES_SQL}, best AS (SELECT * FROM edges WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1),
u AS (SELECT src, dst FROM best UNION SELECT dst, src FROM best), walk AS (SELECT src AS node, src AS other FROM u UNION SELECT walk.node, u.dst FROM walk JOIN u ON walk.other = u.src)
SELECT node, min(other) AS component FROM walk GROUP BY node""")
def graph_components(spark, sf_dir):
    """Components of the graph of each node's strongest edge."""
    return G.components(G.strongest(edges(spark, sf_dir).filter("src != dst"), 1))


@query("transitive_inference", [257, 337], f"""WITH {STRONG_SQL}
SELECT a.src, b.dst, round(max(least(a.weight, b.weight) * 0.9), 6) AS confidence FROM strong a JOIN strong b ON a.dst = b.src WHERE a.src <> b.dst
 AND NOT EXISTS (SELECT 1 FROM strong c WHERE c.src = a.src AND c.dst = b.dst) GROUP BY ALL HAVING max(least(a.weight, b.weight) * 0.9) >= 0.3""")
def transitive_inference(spark, sf_dir):
    found = G.compose(strong(spark, sf_dir), discount=0.9, floor=0.3)
    return found.select("src", "dst", F.round("confidence", 6).alias("confidence"))


@query("path_tiers", [260], f"""WITH {STRONG_SQL}
SELECT a.src, max(CASE WHEN least(a.weight, b.weight) >= 0.7 THEN 3 WHEN least(a.weight, b.weight) >= 0.4 THEN 2 ELSE 1 END)::BIGINT AS best_tier FROM strong a JOIN strong b ON a.dst = b.src GROUP BY a.src""")
def path_tiers(spark, sf_dir):
    """A path is as good as its weakest edge; the best two-step path from each node."""
    own = strong(spark, sf_dir)
    second = own.select(F.col("src").alias("mid"), F.col("weight").alias("w2"))
    weakest = F.least("weight", "w2")
    tier = F.when(weakest >= 0.7, 3).when(weakest >= 0.4, 2).otherwise(1)
    return own.join(second, own["dst"] == second["mid"]).groupBy("src").agg(F.max(tier).cast("long").alias("best_tier"))


@query("document_pair_map", [340], f"""WITH {EDGES_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(n)::BIGINT AS links, count(*)::BIGINT AS directions FROM edges WHERE src <> dst GROUP BY ALL""")
def document_pair_map(spark, sf_dir):
    own = edges(spark, sf_dir).filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return own.agg(F.sum("n").alias("links"), F.count("*").alias("directions"))


@query("isolated_nodes", [55, 254], f"""WITH {STRONG_SQL} SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM strong)""")
def isolated_nodes(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey").join(strong(spark, sf_dir).select(F.col("dst").alias("s_suppkey")), "s_suppkey", "left_anti")
