"""Vector operators: dot products, top-k of a stated set of queries, centroids, standard scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import comparable, nearest


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, blocks: int = 1, within: str | None = None, across: str | None = None) -> DataFrame:
    """For each query (query_id, query) the k nearest other rows by cosine: query_id, id, similarity, rank.

    The queries are a stated set. They and the rows are dealt to lists of a
    bounded number, which meet as matrix products; what is shuffled is k rows
    for a query and a list of rows. Rows without a vector, or with a component
    that is no finite number, take no part.
    blocks: lists of queries at least. within, across: a column of both sides that must be equal, or differ.
    """
    tag = within or across
    tagged = (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag")
    asked = queries.select(F.col("query_id").alias("id"), F.col("query").alias("v"), tagged).filter(comparable("v"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), tagged).filter(comparable("v"))
    best = nearest(rows, asked, k, "within" if within else "across" if across else "", blocks=blocks)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def centroids(df: DataFrame, group: str, vector_col: str) -> DataFrame:
    """group and its mean vector."""
    parts = df.select(group, F.posexplode(vector_col).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = parts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))
    return lists.select(group, F.transform("c", lambda p: p["m"]).alias("centroid"))


def standard_scores(df: DataFrame, group: str, score: str) -> DataFrame:
    """z of each score in its group; groups that hardly vary are left out."""
    w = Window.partitionBy(group)
    own = df.withColumn("_m", F.avg(score).over(w)).withColumn("_s", F.stddev_pop(score).over(w)).filter("_s >= 0.001")
    return own.withColumn("z", (F.col(score) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
