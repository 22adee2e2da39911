"""Statements about parts, as text: what an order line says of its part, for the operators on values in text.

A part's statements have one unit, so that they can be compared; the kind of
value varies with the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

STATEMENTS_SQL = """statements AS (
  SELECT subject, source_doc, order_id, line, stated_at, authority, scope, hedge,
    CASE WHEN q % 10 = 9 THEN 'colour ' || scope ELSE CASE line
      WHEN 1 THEN q || ' ' || unit WHEN 2 THEN 'between ' || q || ' and ' || (q + 5) || ' ' || unit
      WHEN 3 THEN 'at most ' || q || ' ' || unit WHEN 4 THEN 'at least ' || q || ' ' || unit
      WHEN 5 THEN 'one of ' || q || ', ' || (q + 1) || ', ' || (q + 2) || ' ' || unit
      WHEN 6 THEN 'version v' || (q % 4) || '.' || (d % 3) || '.' || t ELSE CASE WHEN d % 2 = 0 THEN 'is enabled' ELSE 'is disabled' END END END AS object_text
  FROM (SELECT l_partkey AS subject, l_suppkey AS source_doc, l_orderkey AS order_id, l_linenumber::BIGINT AS line, l_shipdate AS stated_at,
      l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t, l_returnflag AS scope, l_discount AS hedge,
      CASE l_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'mm' WHEN 2 THEN 'ms' ELSE '%' END AS unit,
      CASE WHEN l_discount < 0.025 THEN 'HIGH' WHEN l_discount < 0.075 THEN 'MEDIUM' ELSE 'LOW' END AS authority FROM lineitem))"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, source_doc, order_id, line, stated_at, authority, scope, hedge, object_text of each order line."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("subject"),
        F.col("l_suppkey").alias("source_doc"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_shipdate").alias("stated_at"),
        F.when(F.col("l_discount") < 0.025, "HIGH").when(F.col("l_discount") < 0.075, "MEDIUM").otherwise("LOW").alias("authority"),
        F.col("l_returnflag").alias("scope"),
        F.col("l_discount").alias("hedge"),
        F.col("l_quantity").cast("long").alias("q"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"),
        F.round(F.col("l_tax") * 100).cast("long").alias("t"),
        F.element_at(F.array(*map(F.lit, ("kg", "mm", "ms", "%"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("unit"),
    )
    q, unit = F.col("q").cast("string"), F.col("unit")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    more = lambda n: (F.col("q") + n).cast("string")
    said = (
        F.when(F.col("q") % 10 == 9, text("colour ", F.col("scope")))
        .when(F.col("line") == 1, text(q, " ", unit))
        .when(F.col("line") == 2, text("between ", q, " and ", more(5), " ", unit))
        .when(F.col("line") == 3, text("at most ", q, " ", unit))
        .when(F.col("line") == 4, text("at least ", q, " ", unit))
        .when(F.col("line") == 5, text("one of ", q, ", ", more(1), ", ", more(2), " ", unit))
        .when(F.col("line") == 6, text("version v", (F.col("q") % 4).cast("string"), ".", (F.col("d") % 3).cast("string"), ".", F.col("t").cast("string")))
        .otherwise(F.when(F.col("d") % 2 == 0, "is enabled").otherwise("is disabled"))
    )
    return lines.withColumn("object_text", said).drop("q", "d", "t", "unit")
