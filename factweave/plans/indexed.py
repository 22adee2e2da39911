"""Searches through the vector index; their results are measured against exact search in the tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import density, linkage, louvain
from ..operators import index as I
from ..operators import vectors as V
from ..operators.graph import cut
from ..sources.tables import read
from .registry import query


def through_index(rows, k, rule="", tag=None, least=None, recall=0.95):
    """Every row whose id is divisible by 20 asks all rows; visits are chosen so that tried queries find ``recall`` of their neighbours."""
    index = I.build(rows, "vec_id", "embedding", tag)
    asked = index.rows.filter("id % 20 = 0").select("id", "v", "tag")
    index = I.choose_visits(index, asked, k, recall, rule, least)
    return I.search(index, asked, k, index.visits, rule, least)


@query("indexed_top_k", [124])
def indexed_top_k(spark, sf_dir):
    """The ten nearest rows of every query, through the index."""
    return through_index(read(spark, sf_dir, "embeddings"), 10)


@query("indexed_cross_document", [57])
def indexed_cross_document(spark, sf_dir):
    """Up to five rows of another group with a similarity of 0.3 at least, for every query, through the index."""
    return through_index(read(spark, sf_dir, "embeddings"), 5, "across", "label", 0.3).select("query_id", "id", F.col("similarity"), "rank")


@query("similarity_join", [57], """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3""")
def similarity_join(spark, sf_dir):
    """All pairs of rows with a cosine of 0.3 at least, by the index's cells and their angles."""
    return I.pairs_over(I.build(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 0.3)


@query("linkage_clusters", [166, 349])
def linkage_clusters(spark, sf_dir):
    """Clusters by complete linkage: any two vectors of one have a cosine of 0.3 at least."""
    return linkage.linkage_clusters(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3)


def neighbour_graph(spark, sf_dir, k=8, least=0.1):
    """src, dst, weight: each row's k nearest others with a similarity of ``least`` at least."""
    found = B.neighbours(I.plain_rows(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", None).select("id", "v"), k, least)
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("similarity").alias("weight"))


@query("louvain_communities", [265])
def louvain_communities(spark, sf_dir):
    """Communities of the largest component of the graph of nearest neighbours, by modularity."""
    return louvain.louvain(louvain.giant_component(neighbour_graph(spark, sf_dir)))


def density_members(rows, k, core, least, merge, attach):
    """id, cluster, attached of all rows (id, embedding): density clusters on the graph of neighbours, like centroids merged, near noise attached."""
    plain = I.plain_rows(rows, "id", "embedding", None).select("id", "v")
    every = cut(plain.withColumn("v", B.of_width(F.col("v"), B.width_of(plain))))  # shorter vectors count as ending in zeros
    near = B.neighbours(every, k).select("query_id", "id", F.round(1 - F.col("similarity"), 6).alias("distance"), "rank")
    found = cut(density.density_clusters(density.mutual_reachability(cut(near), core), least))
    members = lambda of: every.join(of.filter("cluster is not null").withColumnRenamed("node", "id"), "id")
    joined = cut(density.merge_alike(found, cut(density.centroids_of(members(found))), merge))
    centres = cut(density.centroids_of(members(joined)))
    return density.attach_noise(every, joined, centres, attach)


@query("density_facets", [269])
def density_facets(spark, sf_dir):
    """Density clusters of all vectors (eight rows at least), quasi equal ones merged at 0.95, noise attached at 0.87; noise has no cluster.

    Distances are taken on the vectors themselves, not on a projection of them.
    """
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return density_members(rows, 12, 3, 8, 0.95, 0.87)


@query("multi_signal_pairs", [58], """WITH c AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, o_orderpriority AS facet, o_custkey AS node FROM embeddings LEFT JOIN orders ON o_orderkey = vec_id),
e AS (SELECT DISTINCT x.l_orderkey AS a, y.l_orderkey AS b FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey AND x.l_orderkey < y.l_orderkey WHERE x.l_orderkey IN (SELECT vec_id FROM embeddings) AND y.l_orderkey IN (SELECT vec_id FROM embeddings)),
s AS (SELECT x.vec_id AS a, y.vec_id AS b, round(0.30::DOUBLE * round(list_cosine_similarity(x.v, y.v), 6) + CASE WHEN e.a IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN x.facet = y.facet THEN 0.15::DOUBLE ELSE 0 END
 + CASE WHEN x.label = y.label THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN x.node = y.node THEN 0.10::DOUBLE ELSE 0 END, 6) AS score FROM c x JOIN c y ON x.vec_id < y.vec_id LEFT JOIN e ON e.a = x.vec_id AND e.b = y.vec_id)
SELECT a, b, score FROM s WHERE score >= 0.55""")
def multi_signal_pairs(spark, sf_dir):
    """Pairs of claims whose weighted signals reach 0.55: cosine (0.30), a shared part (0.25), the same priority (0.15), cluster (0.20), the same customer (0.10).

    A claim's vector and its order have one id. All signals but the cosine are
    known from keys, and the cosine gives 0.30 at most, so a pair has a part in
    common or two of the other keys. Pairs meet by these only, as lists of a key's
    rows, and only those that may reach 0.55 leave the task.
    """
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("facet"), F.col("o_custkey").alias("node"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("v"))
    claims = cut(rows.filter(B.comparable("v")).join(orders, "id", "left"))
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part")).filter("part is not null")
    parts = parts.join(claims.select("id"), "id", "left_semi").distinct().join(claims, "id")
    two = lambda *c: F.when(F.concat(*[F.col(x).cast("string") for x in c]).isNotNull(), F.concat_ws("\x1f", F.lit("-".join(c)), *c))
    keyed = claims.select("*", F.explode(F.array(two("label", "facet"), two("label", "node"), two("facet", "node"))).alias("key")).filter("key is not null")
    keyed = keyed.withColumn("base", F.lit(0.0)).unionByName(parts.select("*", F.concat_ws("\x1f", F.lit("part"), "part").alias("key"), F.lit(0.25).alias("base")).drop("part"))
    near = B.signal_pairs(keyed, {"facet": 0.15, "label": 0.20, "node": 0.10}, 0.30, 0.55)
    score = F.round(0.30 * F.col("similarity") + F.col("base") + F.col("facet") + F.col("label") + F.col("node"), 6)
    return near.groupBy("a", "b").agg(F.max(score).alias("score")).filter("score >= 0.55")


@query("balanced_rerank", [116], """WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label AS side, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) <= 30),
s AS (SELECT query_id, count(DISTINCT side) AS sides FROM n GROUP BY query_id), k AS (SELECT n.*, row_number() OVER (PARTITION BY query_id, side ORDER BY similarity DESC, id) AS place, ceil(10 / sides) AS quota FROM n JOIN s USING (query_id) QUALIFY place <= quota)
SELECT query_id, id, side, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::BIGINT AS rank FROM k""")
def balanced_rerank(spark, sf_dir):
    """Of every query's thirty nearest rows an equal quota from each group (ten in all, rounded up), so that no side of a comparison is crowded out."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = V.top_k(rows, asked, "vec_id", "embedding", 30).select("query_id", "id", "similarity")
    near = near.join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("side")), "id")
    sides = F.size(F.collect_set("side").over(Window.partitionBy("query_id")))  # of thirty rows
    own = Window.partitionBy("query_id", "side").orderBy(F.desc("similarity"), "id")
    kept = near.withColumn("quota", F.ceil(10 / sides)).withColumn("place", F.row_number().over(own)).filter("place <= quota")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return kept.select("query_id", "id", "side", "similarity", F.row_number().over(order).cast("long").alias("rank"))
