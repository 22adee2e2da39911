"""Rules, limits, quotas, sampling, usage and telemetry over the event stream, as batch queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.rules import Condition, Rule, first_match
from ..sources.tables import minute, read
from .registry import query


@query("rule_decisions", [33, 34, 35, 36], """SELECT p_partkey, CASE WHEN p_retailprice > 1500 AND contains(lower(p_type), 'steel') THEN 'REVIEW' WHEN starts_with(lower(p_brand), 'brand#1') OR lower(p_name) = 'small ring' THEN 'REJECT'
  WHEN p_size IN (1, 2, 3) THEN 'FLAG' ELSE 'ACCEPT' END AS action, CASE WHEN p_retailprice > 1500 AND contains(lower(p_type), 'steel') THEN 'dear steel' WHEN starts_with(lower(p_brand), 'brand#1') OR lower(p_name) = 'small ring' THEN 'brand or name'
  WHEN p_size IN (1, 2, 3) THEN 'small' ELSE '-' END AS rule FROM part""")
def rule_decisions(spark, sf_dir):
    rules = [
        Rule("dear steel", 90, [Condition("p_retailprice", "greater_than", 1500), Condition("p_type", "contains", "STEEL")], "REVIEW"),
        Rule("brand or name", 50, [Condition("p_brand", "starts_with", "Brand#1"), Condition("p_name", "equals", "Small Ring")], "REJECT", match_any=True),
        Rule("small", 10, [Condition("p_size", "in", [1, 2, 3])], "FLAG"),
    ]
    action, name = first_match(rules)
    return read(spark, sf_dir, "part").select("p_partkey", action.alias("action"), name.alias("rule"))


@query("escalating_filter", [30, 31], """WITH t AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS tier, o_orderkey, o_custkey FROM orders),
n AS (SELECT o_custkey, tier, sum(count(*)) OVER (PARTITION BY o_custkey ORDER BY tier) AS upto FROM t GROUP BY o_custkey, tier), p AS (SELECT o_custkey, coalesce(min(tier) FILTER (WHERE upto >= 4), 4) AS step FROM n GROUP BY o_custkey)
SELECT o_custkey, step::BIGINT AS step, count(*)::BIGINT AS orders FROM t JOIN p USING (o_custkey) WHERE tier <= step GROUP BY o_custkey, step""")
def escalating_filter(spark, sf_dir):
    """For each customer the narrowest tiers that leave four rows, or all."""
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(4)
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey", tier.alias("tier")).agg(F.count("*").alias("n"))
    own = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("o_custkey").orderBy("tier")))
    own = own.withColumn("step", F.coalesce(F.min(F.when(F.col("upto") >= 4, F.col("tier"))).over(Window.partitionBy("o_custkey")), F.lit(4)))
    return own.filter("tier <= step").groupBy("o_custkey", F.col("step").cast("long").alias("step")).agg(F.sum("n").alias("orders"))


@query("visibility_profiles", [32], """WITH p(segment, least) AS (VALUES ('BUILDING', 100000.0), ('MACHINERY', 200000.0)),
v AS (SELECT c_mktsegment, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN p ON c_mktsegment = segment WHERE o_totalprice >= least)
SELECT c_mktsegment, count(*)::BIGINT AS visible, round(max(o_totalprice), 2) AS best FROM v GROUP BY c_mktsegment""")
def visibility_profiles(spark, sf_dir):
    profiles = spark.createDataFrame([("BUILDING", 100000.0), ("MACHINERY", 200000.0)], "segment string, least double")
    customers = read(spark, sf_dir, "customer").join(F.broadcast(profiles), F.col("c_mktsegment") == F.col("segment"))
    both = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).filter("o_totalprice >= least")
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("visible"), F.round(F.max("o_totalprice"), 2).alias("best"))


@query("sliding_rate_limit", [296], """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS in_window,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 2 AS rejected FROM events""")
def sliding_rate_limit(spark, sf_dir):
    """Requests of a user in the hour up to each request, and whether that is too many."""
    seen = F.expr("count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
    return read(spark, sf_dir, "events").select("event_id", seen.alias("in_window"), (seen > 2).alias("rejected"))


@query("daily_quota", [297, 354], """SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)::BIGINT AS used,
  row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def daily_quota(spark, sf_dir):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    used = F.row_number().over(w).cast("long")
    return read(spark, sf_dir, "events").select("event_id", used.alias("used"), (used <= 2).alias("allowed"))


@query("concurrency_slots", [298], """SELECT event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM events""")
def concurrency_slots(spark, sf_dir):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "events").select("event_id", F.sum(step).over(w).alias("held"))


@query("idempotent_requests", [300], """WITH k AS (SELECT event_id, ts, user_id, event_type, md5(floor(value)::BIGINT::VARCHAR) AS request, first_value(md5(floor(value)::BIGINT::VARCHAR)) OVER w AS first_request, row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id))
SELECT event_id, CASE WHEN rn = 1 THEN 'reserve' WHEN request = first_request THEN 'return stored' ELSE 'conflict' END AS outcome FROM k""")
def idempotent_requests(spark, sf_dir):
    """The first request of a key in a day reserves; equal ones get its answer, different ones conflict."""
    w = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    request = F.md5(F.floor("value").cast("string"))
    own = read(spark, sf_dir, "events").select("event_id", request.alias("request"), F.first(request).over(w).alias("first"), F.row_number().over(w).alias("rn"))
    return own.select("event_id", F.when(F.col("rn") == 1, "reserve").when(F.col("request") == F.col("first"), "return stored").otherwise("conflict").alias("outcome"))


@query("latency_histograms", [301], """WITH b AS (SELECT event_type, CASE WHEN value <= 10 THEN 10 WHEN value <= 25 THEN 25 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 ELSE 1000000 END AS le FROM events WHERE value IS NOT NULL),
c AS (SELECT event_type, le, sum(count(*)) OVER (PARTITION BY event_type ORDER BY le) AS cumulative, sum(count(*)) OVER (PARTITION BY event_type) AS total FROM b GROUP BY event_type, le)
SELECT event_type, max(total)::BIGINT AS total, min(le) FILTER (WHERE cumulative >= 0.5 * total)::BIGINT AS p50, min(le) FILTER (WHERE cumulative >= 0.95 * total)::BIGINT AS p95, min(le) FILTER (WHERE cumulative >= 0.99 * total)::BIGINT AS p99 FROM c GROUP BY event_type""")
def latency_histograms(spark, sf_dir):
    """Quantiles as the bound of the first bucket that reaches them."""
    le = F.lit(1000000)
    for bound in (100, 50, 25, 10):
        le = F.when(F.col("value") <= bound, bound).otherwise(le)
    counts = read(spark, sf_dir, "events").filter("value is not null").groupBy("event_type", le.cast("long").alias("le")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    own = counts.withColumn("upto", F.sum("n").over(w.orderBy("le"))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("le")))
    return own.groupBy("event_type").agg(F.max("total").alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("trace_sampling", [302], """SELECT event_id, event_type = 'error' OR ('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT % 10000 < 500 AS traced FROM events""")
def trace_sampling(spark, sf_dir):
    """Errors always, else a share by a hash of the id."""
    bucket = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 10000
    return read(spark, sf_dir, "events").select("event_id", ((F.col("event_type") == "error") | (bucket < 500)).alias("traced"))


@query("budget_tracker", [304], """SELECT event_id, CASE WHEN s > 1000 THEN 'hard' WHEN s > 500 THEN 'soft' ELSE 'ok' END AS state FROM (
  SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS s FROM events)""")
def budget_tracker(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.round(F.sum("value").over(w), 6)
    return read(spark, sf_dir, "events").select("event_id", F.when(spent > 1000, "hard").when(spent > 500, "soft").otherwise("ok").alias("state"))


@query("usage_rollup", [93, 94, 341], """WITH p(event_type, price) AS (VALUES ('click', 0.1), ('view', 0.02), ('purchase', 1.5), ('signup', 0.5), ('error', 0.0))
SELECT coalesce(event_type, '*') AS task, count(*)::BIGINT AS calls, round(sum(value * price), 2) AS cost FROM events JOIN p USING (event_type) GROUP BY ROLLUP (event_type)""")
def usage_rollup(spark, sf_dir):
    prices = spark.createDataFrame([("click", 0.1), ("view", 0.02), ("purchase", 1.5), ("signup", 0.5), ("error", 0.0)], "event_type string, price double")
    both = read(spark, sf_dir, "events").join(F.broadcast(prices), "event_type")
    own = both.rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("value") * F.col("price")), 2).alias("cost"))
    return own.select(F.coalesce("event_type", F.lit("*")).alias("task"), "calls", "cost")


@query("sessions", [303], """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins FROM s GROUP BY user_id, session""")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    new = F.when(before.isNull() | (F.col("ts") > before + F.expr("INTERVAL 6 HOURS")), 1).otherwise(0)
    own = read(spark, sf_dir, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("user_id", "session").agg(F.count("*").alias("events"), minute(F.min("ts")).alias("begins"))


@query("job_states", [306, 308], """SELECT user_id, max(struct_pack(t := ts, i := event_id, s := event_type)).s AS state, count(*)::BIGINT AS steps, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failures FROM events GROUP BY user_id""")
def job_states(spark, sf_dir):
    own = read(spark, sf_dir, "events").groupBy("user_id")
    return own.agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("failures"))
