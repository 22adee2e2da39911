"""Domain views over the given tables, and the same views in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

FACTS_SQL = """facts AS (
  SELECT event_id AS fact_id, 'tenant_' || (user_id % 4) AS tenant_id, 'user_' || user_id AS subject,
         event_type AS predicate, value, CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'proposed' END AS status,
         ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_until,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS source_document
  FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject-predicate-value facts from events; a fact holds until the subject's next one of the predicate."""
    events = read(spark, sf_dir, "events")
    following = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return events.select(
        F.col("event_id").alias("fact_id"),
        F.concat(F.lit("tenant_"), F.col("user_id") % 4).alias("tenant_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("subject"),
        F.col("event_type").alias("predicate"),
        "value",
        F.when(F.col("event_id") % 2 == 0, "approved").otherwise("proposed").alias("status"),
        F.col("ts").alias("valid_from"),
        F.lead("ts").over(following).alias("valid_until"),
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long").alias("source_document"),
    )


SENTENCE = r"[^.!?\n]+[.!?]?"

CLAIMS_SQL = r"""claims AS (
  SELECT doc_id, lang, source, pos, trim(raw) AS claim_text FROM (
    SELECT doc_id, lang, source, unnest(m) AS raw, generate_subscripts(m, 1) - 1 AS pos
    FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[^.!?\n]+[.!?]?') AS m FROM documents))
  WHERE length(trim(raw)) >= 10)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of documents that have 10 characters at least: doc_id, lang, source, pos, claim_text."""
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", "lang", "source", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("pos", "raw"))
    return found.select("doc_id", "lang", "source", F.col("pos").cast("long").alias("pos"), F.trim("raw").alias("claim_text")).filter(
        F.length("claim_text") >= 10
    )


TOKENS_SQL = r"""tokens AS (
  SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run of letters a-z and digits in the lower-cased documents."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))


OFFERS_SQL = """offers AS (
  SELECT l_partkey AS subject, l_suppkey AS source_doc, l_orderkey AS claim_id, l_returnflag AS claim_type, l_linestatus AS scope,
         l_extendedprice / l_quantity AS value, l_discount AS hedge, l_shipdate AS stated_at
  FROM lineitem)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about parts: each order line states a unit price, and its supplier is the source document."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_partkey").alias("subject"),
        F.col("l_suppkey").alias("source_doc"),
        F.col("l_orderkey").alias("claim_id"),
        F.col("l_returnflag").alias("claim_type"),
        F.col("l_linestatus").alias("scope"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
        F.col("l_discount").alias("hedge"),
        F.col("l_shipdate").alias("stated_at"),
    )
