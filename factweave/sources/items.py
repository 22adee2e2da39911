"""Documents as items in reading order: headings with a level, paragraphs, table rows, code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

ITEMS_SQL = """items AS (SELECT doc_id, pos, line, CASE WHEN contains(line, '|') THEN 'table' WHEN contains(line, '%%%') OR contains(line, '###') THEN 'code' WHEN length(line) < 60 THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN contains(line, '|') OR contains(line, '%%%') OR contains(line, '###') OR length(line) >= 60 THEN 0 WHEN length(line) < 20 THEN 1 WHEN length(line) < 40 THEN 2 ELSE 3 END::BIGINT AS level
  FROM (SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, trim(unnest(m)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS m FROM documents)) WHERE line <> '')"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line, kind, level: the non-empty lines of documents. Short lines are headings, the shorter the higher."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    kind = F.when(F.contains(line, F.lit("|")), "table").when(F.contains(line, F.lit("%%%")) | F.contains(line, F.lit("###")), "code").when(F.length(line) < 60, "heading").otherwise("paragraph")
    level = F.when(F.col("kind") != "heading", 0).when(F.length(line) < 20, 1).when(F.length(line) < 40, 2).otherwise(3)
    own = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("line").alias("line")).filter("line != ''")
    return own.withColumn("kind", kind).withColumn("level", level.cast("long"))
