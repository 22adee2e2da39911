"""Sinks and keyed stores on files: upsert, delete, merge, artifacts with checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of each key with the largest version; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def delete_where(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def merge_properties(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New properties win where they are not null; keys of either side stay."""
    properties = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in properties])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in properties])
    return o.join(n, list(keys), "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in properties])


def export_artifact(rows: DataFrame, key: str, place: str) -> None:
    """Rows as Parquet with a checksum of each, and a manifest of their number."""
    checked = rows.withColumn("checksum", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256))
    checked.write.parquet(f"{place}/rows")
    checked.agg(F.count(key).alias("rows")).write.json(f"{place}/manifest")


def import_artifact(spark: SparkSession, place: str) -> DataFrame:
    """The artifact's rows whose checksum holds; it refuses an artifact whose number of rows isn't the manifest's."""
    rows = spark.read.parquet(f"{place}/rows")
    said = spark.read.json(f"{place}/manifest").first()["rows"]
    if rows.count() != said:
        raise ValueError("the manifest has another number of rows")
    plain = [c for c in rows.columns if c != "checksum"]
    return rows.filter(F.col("checksum") == F.sha2(F.to_json(F.struct(*sorted(plain))), 256)).drop("checksum")
