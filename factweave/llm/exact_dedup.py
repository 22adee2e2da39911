"""Exact dedup by skew-safe combining.

1. Each task deduplicates its own rows (the map side of the first aggregation).
2. What is left meets in salted digest groups, so that a text with a third of
   all rows is spread over ``salts`` tasks.
3. The winners of the salts, at most ``salts`` rows for a text, are combined.

Every stage groups by the digest and the full text: two texts that share a
digest never merge. Documents then find their group by digest alone where that
is unambiguous, and by digest and text where a digest has several texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table, with_row_key, without_ids


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after A-Z are lower-cased; null
    counts as empty. The row with the largest id stays; a null id loses against
    any other and stays only in a group whose ids are all null. Rows that
    repeat an id and a text count one by one in group_size and share ``kept``.
    Other columns of docs are not read. An empty table gives no rows.

    digest: only groups rows; with a weak one the results stay right.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))

    local_and_salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("salt", "digest", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    winners = (
        local_and_salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    by_digest = winners.groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    groups = materialize(by_digest, "dedup-groups")

    text_sha256 = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    ids = rows.select("doc_id", "digest", text_sha256.alias("text_sha256"))
    out = ids.join(groups.filter("texts = 1").drop("texts"), "digest")
    shared = groups.filter("texts > 1").select("digest")
    if not shared.isEmpty():
        some = winners.join(shared, "digest", "left_semi")
        out = out.unionByName(
            rows.join(some, ["digest", "norm"]).select(
                "digest", "doc_id", text_sha256.alias("text_sha256"), "keep_id", "group_size"
            )
        )
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage_exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that with the largest id.

    Rows that repeat an id, null among them, count one by one: only equal texts go.
    """
    rows, row = with_row_key(docs, "doc_id")
    dropped = exact_dedup(rows, id_col=row).filter("not kept").select("doc_id")
    return without_ids(rows, dropped, row).drop(row)


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
"""
