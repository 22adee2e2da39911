"""Concepts that share a key are one: clusters kept up to date as batches come.

What is stored is the cluster of every key, as a first table and one table of
changes for each batch; of a key the latest row counts. A batch reads only the
rows of its own keys and of clusters that it joins, works out components among
its items and those clusters, and writes the keys that are new or have changed
hands. Clusters are named by their smallest item, so the names are the same
whatever the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .graph import components, written


class ConceptStore:
    """The clusters of keys in a folder of tables, the latest of which counts for each key."""

    def __init__(self, spark: SparkSession, place: str | None = None) -> None:
        self.spark = spark
        self.place = place or shared_folder(spark, "concepts")
        self.version = 0
        self.changes: list[int] = []

    def known(self) -> DataFrame | None:
        """key, cluster as of now."""
        if not self.version:
            return None
        rows = self.spark.read.parquet(*[f"{self.place}/v{n}" for n in range(1, self.version + 1)])
        return rows.groupBy("key").agg(F.max_by("cluster", "version").alias("cluster"))

    def insert(self, batch: DataFrame) -> DataFrame:
        """Takes in the rows (item, key) of a batch and gives what was merged: old, new names of clusters.

        An item may have any number of keys; rows with a null stand for nothing. Items of
        earlier batches may come again with more keys.
        """
        rows = written(batch.filter("item is not null and key is not null").select("item", "key").distinct())
        known = self.known()
        first = rows.groupBy("key").agg(F.min("item").alias("least"))
        if known is None:
            links = rows.join(first, "key").select(F.col("item").alias("src"), F.col("least").alias("dst"))
        else:
            touched = known.join(rows.select("key").distinct(), "key", "left_semi")
            links = rows.join(first, "key").join(touched, "key", "left").select(F.col("item").alias("src"), F.coalesce("cluster", "least").alias("dst"))
        links = written(links.distinct())
        found = components(links)  # an item whose link is to itself is a component of its own
        found = written(found.select("node", "component"))
        of = rows.join(found, rows["item"] == found["node"]).groupBy("key").agg(F.min("component").alias("cluster"))
        if known is None:
            merged, changed = found.limit(0).select(F.col("node").alias("old"), F.col("component").alias("new")), of
        else:
            clusters = touched.select("cluster").distinct()
            merged = written(clusters.join(found, clusters["cluster"] == found["node"]).filter("node != component").select(F.col("node").alias("old"), F.col("component").alias("new")))
            moved = known.join(merged, known["cluster"] == merged["old"]).select("key", F.col("new").alias("cluster"))
            new = of.join(known, "key", "left_anti").select("key", "cluster")
            changed = moved.unionByName(new)
        self.version += 1
        target = f"{self.place}/v{self.version}"
        changed.select("key", "cluster", F.lit(self.version).alias("version")).write.parquet(target)
        self.changes.append(self.spark.read.parquet(target).count())
        return merged

    def compact(self) -> None:
        """One table instead of many; what it has is the same."""
        rows = self.known()
        if rows is not None:
            rows = written(rows)
            self.place, self.version = shared_folder(self.spark, "concepts"), 1
            rows.select("key", "cluster", F.lit(1).alias("version")).write.parquet(f"{self.place}/v1")

    def resolve(self, items: DataFrame) -> DataFrame:
        """item, cluster of the rows (item, key) that were taken in."""
        return items.filter("item is not null").join(self.known(), "key").groupBy("item").agg(F.min("cluster").alias("cluster"))
