"""Nearest vectors, facets and their prototypes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..sources.tables import read
from .registry import query

COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("dense_top_k", [124, 125, 142], f"""SELECT query_id, id, similarity, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round({COSINE}, 6) AS similarity,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 6) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 10""")
def dense_top_k(spark, sf_dir):
    """The ten nearest rows of every query; the queries are the rows whose id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.top_k(rows, asked, "vec_id", "embedding", 10)


CENTROIDS_SQL = """p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i), c AS (SELECT label AS facet, list(x ORDER BY i) AS centroid FROM m GROUP BY label)"""
TO_FACET = "list_cosine_similarity(embedding::DOUBLE[], centroid)"


@query("facet_prototypes", [270], f"""WITH {CENTROIDS_SQL}
SELECT facet, round(sqrt(list_inner_product(centroid, centroid)), 6) AS length, round(centroid[1], 6) AS first FROM c""")
def facet_prototypes(spark, sf_dir):
    own = V.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return own.select(F.col("label").alias("facet"), F.round(V.norm(F.col("centroid")), 6).alias("length"), F.round(F.element_at("centroid", 1), 6).alias("first"))


@query("facet_assignment", [107, 272], f"""WITH {CENTROIDS_SQL}, s AS (SELECT vec_id, facet, round({TO_FACET}, 9) AS score FROM embeddings CROSS JOIN c),
z AS (SELECT *, avg(score) OVER (PARTITION BY vec_id) AS m, stddev_pop(score) OVER (PARTITION BY vec_id) AS d FROM s)
SELECT vec_id, facet, round((score - m) / d, 4) AS z, CASE WHEN (score - m) / d >= 1.2 THEN 'STRONG' ELSE 'WEAK' END AS strength
FROM z WHERE d >= 0.001 AND (score - m) / d >= 0.5 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, facet) <= 2""")
def facet_assignment(spark, sf_dir):
    """Up to two facets of each vector by standard score over the facets, whose number is that of labels."""
    rows = read(spark, sf_dir, "embeddings")
    facets = V.centroids(rows, "label", "embedding").withColumnRenamed("label", "facet")
    all_facets = facets.agg(F.collect_list(F.struct("facet", "centroid")).alias("facets"))
    scored = rows.crossJoin(all_facets).select("vec_id", "embedding", F.explode("facets").alias("f"))
    scored = scored.select("vec_id", "f.facet", F.round(V.cosine(F.col("embedding"), F.col("f.centroid")), 9).alias("score"))
    own = V.standard_scores(scored, "vec_id", "score").filter("z >= 0.5")
    best = own.withColumn("rn", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "facet"))).filter("rn <= 2")
    return best.select("vec_id", "facet", F.round("z", 4).alias("z"), F.when(F.col("z") >= 1.2, "STRONG").otherwise("WEAK").alias("strength"))


@query("trim_to_core", [105, 106], f"""WITH {CENTROIDS_SQL}
SELECT label, vec_id, round({TO_FACET}, 6) AS similarity FROM embeddings JOIN c ON label = facet
QUALIFY row_number() OVER (PARTITION BY label ORDER BY round({TO_FACET}, 6) DESC, vec_id) <= 20""")
def trim_to_core(spark, sf_dir):
    """The twenty members nearest to their cluster's centroid."""
    rows = read(spark, sf_dir, "embeddings")
    own = rows.join(V.centroids(rows, "label", "embedding"), "label").withColumn("similarity", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6))
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    return own.withColumn("rn", F.row_number().over(w)).filter("rn <= 20").select("label", "vec_id", "similarity")


@query("facet_health", [89], f"""WITH {CENTROIDS_SQL}
SELECT label, count(*)::BIGINT AS members, round(avg({TO_FACET}), 6) AS cohesion, count(*) FILTER (WHERE {TO_FACET} >= 0.5)::BIGINT AS strong,
  CASE WHEN count(*) >= 10 THEN 'validated' ELSE 'candidate' END AS state FROM embeddings JOIN c ON label = facet GROUP BY label""")
def facet_health(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    own = rows.join(V.centroids(rows, "label", "embedding"), "label").withColumn("s", V.cosine(F.col("embedding"), F.col("centroid")))
    health = own.groupBy("label").agg(F.count("*").alias("members"), F.round(F.avg("s"), 6).alias("cohesion"), F.count_if(F.col("s") >= 0.5).alias("strong"))
    return health.withColumn("state", F.when(F.col("members") >= 10, "validated").otherwise("candidate"))


@query("facet_merge_candidates", [89, 271], f"""WITH {CENTROIDS_SQL}
SELECT a.facet AS a, b.facet AS b, round(list_cosine_similarity(a.centroid, b.centroid), 6) AS similarity FROM c a JOIN c b ON a.facet < b.facet""")
def facet_merge_candidates(spark, sf_dir):
    """Facets and the similarity of their prototypes: one row for each two facets."""
    facets = V.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")
    lists = facets.agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("all"))
    left = lists.select("all", F.posexplode("all").alias("i", "x"))
    pairs = left.select("x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    return pairs.select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), F.round(V.cosine(F.col("x.centroid"), F.col("y.centroid")), 6).alias("similarity"))


@query("geometry_profile", [90], """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT i::BIGINT AS dimension, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(quantile_cont(x, 0.95), 6) AS p95 FROM p GROUP BY i""")
def geometry_profile(spark, sf_dir):
    """Mean, deviation and 95th percentile of each dimension."""
    parts = read(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    own = parts.groupBy((F.col("i") + 1).cast("long").alias("dimension"))
    return own.agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("deviation"), F.round(F.percentile("x", 0.95), 6).alias("p95"))
