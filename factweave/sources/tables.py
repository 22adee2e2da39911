"""The given tables, and the tenant guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class UnscopedQuery(ValueError):
    """A read of tenant data without a tenant."""


def for_tenant(df: DataFrame, tenant_id: str | None, column: str = "tenant_id", bypass_reason: str | None = None) -> DataFrame:
    """The tenant's rows. Without a tenant it refuses, unless a reason for reading all tenants is given."""
    if tenant_id:
        return df.filter(F.col(column) == tenant_id)
    if bypass_reason:
        return df
    raise UnscopedQuery(f"{column} must be given")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
