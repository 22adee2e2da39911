"""Versions of documents (orders of a customer stand for them): effective, obsolete, current, lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import temporal
from ..sources.tables import read
from .registry import query

def at():
    return F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")


@query("effective_version", [48, 344], """WITH v AS (
  SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderkey) OVER w AS predecessor, lead(o_orderkey) OVER w AS successor
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, coalesce(predecessor, -1) AS predecessor, coalesce(successor, -1) AS successor FROM v WHERE o_orderdate <= TIMESTAMP '1997-01-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def effective_version(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return temporal.latest_before(orders, ["o_custkey"], "o_orderdate", "o_orderkey", at()).fillna(-1, ["predecessor", "successor"]).select("o_custkey", "o_orderkey", "predecessor", "successor")


@query("obsolete_versions", [49], """SELECT o_orderkey FROM (
  SELECT o_orderkey, o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey) AS obsolete FROM orders) WHERE obsolete""")
def obsolete_versions(spark, sf_dir):
    return temporal.with_obsolescence(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate").filter("obsolete").select("o_orderkey")


@query("version_pairs", [50, 71, 246], """SELECT * FROM (
  SELECT lag(o_orderkey) OVER w AS old_id, o_orderkey AS new_id, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS price_change,
         o_orderstatus <> lag(o_orderstatus) OVER w AS status_changed
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE old_id IS NOT NULL""")
def version_pairs(spark, sf_dir):
    """Neighbouring versions only, and what differs between them."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = read(spark, sf_dir, "orders").select(
        F.lag("o_orderkey").over(w).alias("old_id"),
        F.col("o_orderkey").alias("new_id"),
        F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("price_change"),
        (F.col("o_orderstatus") != F.lag("o_orderstatus").over(w)).alias("status_changed"),
    )
    return pairs.filter("old_id is not null")


@query("current_documents", [53], """WITH e AS (
  SELECT o_orderkey AS old_id, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS since FROM orders)
SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01'
  AND o_orderkey NOT IN (SELECT old_id FROM e WHERE since <= TIMESTAMP '1997-01-01')""")
def current_documents(spark, sf_dir):
    """Documents that no successor replaces at the time."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = orders.select(F.col("o_orderkey").alias("old_id"), F.lead("o_orderdate").over(w).alias("from"), F.lit(None).cast("timestamp_ntz").alias("until"))
    return temporal.without_successor(orders.filter(F.col("o_orderdate") <= at()), edges.filter("from is not null"), "o_orderkey", at()).select("o_orderkey")


@query("customer_metrics", [54, 100], """SELECT c_custkey, count(o_orderkey)::BIGINT AS orders, count(DISTINCT o_orderpriority)::BIGINT AS priorities,
       coalesce(round(sum(o_totalprice), 2), 0) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def customer_metrics(spark, sf_dir):
    """Metrics of all customers, also of those without orders; orders are summed before the join."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.countDistinct("o_orderpriority").alias("priorities"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    both = read(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("priorities", F.lit(0)).alias("priorities"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("recency_weights", [110], """SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 1.0
   ELSE round(exp(-0.693 * date_sub('year', o_orderdate, TIMESTAMP '1998-01-01') / 3.0), 6) END AS weight FROM orders""")
def recency_weights(spark, sf_dir):
    weight = temporal.recency_weight(F.col("o_orderdate"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 3.0)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(weight, 6).alias("weight"))


@query("lifecycle_demotion", [38], """SELECT o_orderkey, round(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 1.0 END, 4) AS score,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 1.0 END DESC, o_orderkey)::BIGINT AS place FROM orders""")
def lifecycle_demotion(spark, sf_dir):
    """With a question about the current state, what is out of date loses score and place."""
    score = F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", 0.3).otherwise(1.0)
    w = Window.partitionBy("o_custkey").orderBy(F.desc(score), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 4).alias("score"), F.row_number().over(w).cast("long").alias("place"))


@query("current_ranking", [111], """WITH s AS (
  SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
         min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi,
         percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS recency, count(*) OVER w AS n
  FROM orders WINDOW w AS (PARTITION BY o_custkey)),
scored AS (SELECT *, 0.6 * recency + 0.4 * CASE WHEN hi > lo THEN (o_totalprice - lo) / (hi - lo) ELSE 1.0 END AS score FROM s)
SELECT o_custkey, o_orderkey, round(score, 6) AS score,
       CASE WHEN n = 1 THEN 'auto' WHEN score >= 0.8 THEN 'pick' WHEN score >= 0.5 THEN 'suggest' ELSE 'escalate' END AS decision
FROM scored QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(score, 9) DESC, o_orderkey) = 1""")
def current_ranking(spark, sf_dir):
    """The best candidate of each subject by recency and centrality, and whether it may be taken without asking."""
    w = Window.partitionBy("o_custkey")
    low, high = F.min("o_totalprice").over(w), F.max("o_totalprice").over(w)
    central = F.when(high > low, (F.col("o_totalprice") - low) / (high - low)).otherwise(1.0)
    recency = F.percent_rank().over(w.orderBy("o_orderdate", "o_orderkey"))
    scored = read(spark, sf_dir, "orders").withColumn("score", 0.6 * recency + 0.4 * central).withColumn("n", F.count("*").over(w))
    best = scored.withColumn("rn", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "o_orderkey"))).filter("rn = 1")
    decision = F.when(F.col("n") == 1, "auto").when(F.col("score") >= 0.8, "pick").when(F.col("score") >= 0.5, "suggest").otherwise("escalate")
    return best.select("o_custkey", "o_orderkey", F.round("score", 6).alias("score"), decision.alias("decision"))


@query("latest_by_authority", [112, 123], """SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE NULL END NULLS LAST, o_orderdate DESC, o_orderkey) = 1""")
def latest_by_authority(spark, sf_dir):
    authority = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2)
    w = Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last(authority), F.desc("o_orderdate"), "o_orderkey")
    best = read(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return best.select("o_custkey", "o_orderkey", "o_orderpriority")


@query("status_synonyms", [28], """WITH s(word, status) AS (VALUES ('open', 'O'), ('in progress', 'O'), ('finished', 'F'), ('closed', 'F'), ('partial', 'P'))
SELECT s.word, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN s ON o_orderstatus = s.status GROUP BY s.word""")
def status_synonyms(spark, sf_dir):
    words = [("open", "O"), ("in progress", "O"), ("finished", "F"), ("closed", "F"), ("partial", "P")]
    by_status = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    names = spark.createDataFrame(words, "word string, status string")
    return by_status.join(F.broadcast(names), F.col("o_orderstatus") == F.col("status")).select("word", "orders", "total")


@query("keyword_containment", [27], """SELECT p_partkey, p_name FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), 'brand#12')""")
def keyword_containment(spark, sf_dir):
    """Any keyword in any of several columns, whatever the case."""
    words = {"p_name": "Ring", "p_type": "STEEL", "p_brand": "Brand#12"}
    hits = [F.contains(F.lower(c), F.lit(w.lower())) for c, w in words.items()]
    return read(spark, sf_dir, "part").filter(hits[0] | hits[1] | hits[2]).select("p_partkey", "p_name")


@query("snapshot_compare", [95, 135, 325], """WITH a AS (SELECT o_orderpriority AS metric, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
b AS (SELECT o_orderpriority AS metric, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT metric, coalesce(a.n, 0)::BIGINT AS before, coalesce(b.n, 0)::BIGINT AS after, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM a FULL JOIN b USING (metric)""")
def snapshot_compare(spark, sf_dir):
    cut = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    sides = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(
        F.count_if(F.col("o_orderdate") < cut).alias("before"), F.count_if(F.col("o_orderdate") >= cut).alias("after")
    )
    return sides.withColumn("delta", F.col("after") - F.col("before"))
