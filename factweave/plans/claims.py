"""Claim gates, pairs across documents, orders of axis values, calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import vectors as V
from ..sources.tables import read
from ..sources.views import FACTS_SQL, OFFERS_SQL, facts, offers
from .registry import query

CENTROID_SQL = """p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i), c AS (SELECT label AS facet, list(x ORDER BY i) AS centroid FROM m GROUP BY label)"""


@query("semantic_claim_gate", [40], f"""WITH {CENTROID_SQL}, s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS score FROM embeddings JOIN c ON label = facet)
SELECT vec_id, label, score, CASE WHEN score < 0.3 THEN 'reject' WHEN score < 0.55 THEN 'rewrite' ELSE 'pass' END AS verdict FROM s
QUALIFY score >= 0.55 OR row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 1""")
def semantic_claim_gate(spark, sf_dir):
    """Claims near enough to their group's prototype, and at least the best one of each group."""
    rows = read(spark, sf_dir, "embeddings")
    own = rows.join(V.centroids(rows, "label", "embedding"), "label").withColumn("score", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    verdict = F.when(F.col("score") < 0.3, "reject").when(F.col("score") < 0.55, "rewrite").otherwise("pass")
    return own.withColumn("rn", F.row_number().over(w)).filter("score >= 0.55 or rn = 1").select("vec_id", "label", "score", verdict.alias("verdict"))


@query("cross_document_neighbours", [57], """SELECT query_id, id, similarity FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 20 = 0) WHERE rn <= 3""")
def cross_document_neighbours(spark, sf_dir):
    """The three nearest rows of other groups for every query (ids divisible by 20)."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    return V.top_k(rows, asked, "vec_id", "embedding", 3, across="label").select("query_id", "id", "similarity")


@query("axis_order", [127], """WITH v AS (SELECT DISTINCT p_brand AS value FROM part) SELECT value, 'numeric' AS strategy, row_number() OVER (ORDER BY CAST(regexp_extract(value, '([0-9]+)', 1) AS BIGINT), value)::BIGINT AS place FROM v""")
def axis_order(spark, sf_dir):
    """The order of an axis's values: by number if all have one, by year if all have one, else none is invented."""
    values = read(spark, sf_dir, "part").select(F.col("p_brand").alias("value")).distinct()
    seen = values.agg(F.bool_and(F.col("value").rlike("(19|20)[0-9]{2}")).alias("year"), F.bool_and(F.col("value").rlike("[0-9]+")).alias("numeric"))
    both = values.crossJoin(F.broadcast(seen))
    strategy = F.when(F.col("year"), "year").when(F.col("numeric"), "numeric").otherwise("unknown")
    key = F.when(F.col("year"), F.regexp_extract("value", "((19|20)[0-9]{2})", 1)).when(F.col("numeric"), F.regexp_extract("value", "([0-9]+)", 1)).try_cast("long")
    return both.select("value", strategy.alias("strategy"), F.row_number().over(Window.orderBy(key, "value")).cast("long").alias("place"))


@query("alias_chains", [176], """WITH RECURSIVE a AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders),
w AS (SELECT id AS start, id, 0 AS hops FROM a WHERE id IN (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT start, a.next, hops + 1 FROM w JOIN a ON w.id = a.id WHERE a.next IS NOT NULL AND hops < 10)
SELECT id AS node, hops::BIGINT AS depth FROM w""")
def alias_chains(spark, sf_dir):
    """Old ids to new ids, up to ten steps."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = read(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"), F.lit(1.0).alias("weight")).filter("dst is not null")
    return G.reach(edges, orders.agg(F.min("o_orderkey").alias("node")), 10)


@query("reject_store", [155], f"""WITH {FACTS_SQL}, r AS (SELECT DISTINCT subject, predicate FROM facts WHERE status = 'proposed' AND value < 5 AND valid_from >= TIMESTAMP '2024-01-15')
SELECT predicate, count(*)::BIGINT AS open_facts FROM facts f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.subject = f.subject AND r.predicate = f.predicate) GROUP BY predicate""")
def reject_store(spark, sf_dir):
    """What a rejection within its time to live keeps out: an anti join on the key."""
    own = facts(spark, sf_dir)
    since = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rejected = own.filter((F.col("status") == "proposed") & (F.col("value") < 5) & (F.col("valid_from") >= since)).select("subject", "predicate").distinct()
    return own.join(rejected, ["subject", "predicate"], "left_anti").groupBy("predicate").agg(F.count("*").alias("open_facts"))


@query("vocabulary", [92, 215], f"""WITH {FACTS_SQL} SELECT DISTINCT tenant_id, CASE predicate WHEN 'view' THEN 'SEEN_BY' WHEN 'click' THEN 'SEEN_BY' ELSE upper(predicate) END AS predicate FROM facts""")
def vocabulary(spark, sf_dir):
    """Predicates of each tenant after synonyms."""
    names = F.when(F.col("predicate").isin("view", "click"), "SEEN_BY").otherwise(F.upper("predicate"))
    return facts(spark, sf_dir).select("tenant_id", names.alias("predicate")).distinct()


@query("interval_comparison", [233], f"""WITH {OFFERS_SQL}, i AS (SELECT subject, claim_type, min(value) AS lo, max(value) AS hi FROM offers WHERE claim_type IN ('A', 'R') GROUP BY ALL)
SELECT a.subject, CASE WHEN a.hi < b.lo OR b.hi < a.lo THEN 'CONTRADICTS' WHEN a.lo >= b.lo AND a.hi <= b.hi THEN 'SUPPORTS' ELSE 'PARTIAL' END AS verdict FROM i a JOIN i b USING (subject) WHERE a.claim_type = 'A' AND b.claim_type = 'R'""")
def interval_comparison(spark, sf_dir):
    """The interval of values that one kind of claim states against that of another."""
    at = lambda f, kind: f(F.when(F.col("claim_type") == kind, F.col("value")))
    own = offers(spark, sf_dir).groupBy("subject").agg(at(F.min, "A").alias("alo"), at(F.max, "A").alias("ahi"), at(F.min, "R").alias("blo"), at(F.max, "R").alias("bhi"))
    own = own.filter("alo is not null and blo is not null")
    verdict = F.when(F.expr("ahi < blo or bhi < alo"), "CONTRADICTS").when(F.expr("alo >= blo and ahi <= bhi"), "SUPPORTS").otherwise("PARTIAL")
    return own.select("subject", verdict.alias("verdict"))


@query("calibration_threshold", [230], """WITH s AS (SELECT n_chars AS score, quality = 1 AS good, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
c AS (SELECT score, sum(sum(n) FILTER (WHERE good)) OVER (ORDER BY score DESC) AS tp, sum(sum(n) FILTER (WHERE NOT good)) OVER (ORDER BY score DESC) AS fp FROM s GROUP BY score),
t AS (SELECT sum(n) FILTER (WHERE good) AS pos, sum(n) FILTER (WHERE NOT good) AS neg FROM s)
SELECT score AS threshold, round(coalesce(tp, 0)::DOUBLE / pos - coalesce(fp, 0)::DOUBLE / neg, 6) AS youden FROM c CROSS JOIN t ORDER BY youden DESC, score LIMIT 1""")
def calibration_threshold(spark, sf_dir):
    """The score with the largest difference of true and false positive rates: windows over counts of each score."""
    both = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")).join(read(spark, sf_dir, "labels"), "doc_id")
    counts = both.groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    down, every = Window.orderBy(F.desc("score")), Window.partitionBy(F.lit(0))
    rate = lambda c: F.sum(c).over(down) / F.sum(c).over(every)
    scored = counts.select(F.col("score").alias("threshold"), F.round(rate("good") - rate("bad"), 6).alias("youden"))
    return scored.orderBy(F.desc("youden"), "threshold").limit(1)


@query("evidence_bundles", [247, 249], f"""WITH {OFFERS_SQL}, b AS (SELECT subject, claim_type, least(min(1 - hedge), avg(1 - hedge)) AS confidence, count(DISTINCT scope) AS sections, count(*) AS n FROM offers GROUP BY ALL)
SELECT subject, claim_type, round(confidence, 6) AS confidence, CASE WHEN n < 2 THEN 'ABSTAIN' WHEN confidence >= 0.92 AND sections >= 2 THEN 'STRICT' ELSE 'EXTENDED' END AS tier FROM b""")
def evidence_bundles(spark, sf_dir):
    """A bundle is as sure as its least sure part."""
    own = offers(spark, sf_dir).groupBy("subject", "claim_type").agg(
        F.least(F.min(1 - F.col("hedge")), F.avg(1 - F.col("hedge"))).alias("confidence"), F.countDistinct("scope").alias("sections"), F.count("*").alias("n")
    )
    tier = F.when(F.col("n") < 2, "ABSTAIN").when((F.col("confidence") >= 0.92) & (F.col("sections") >= 2), "STRICT").otherwise("EXTENDED")
    return own.select("subject", "claim_type", F.round("confidence", 6).alias("confidence"), tier.alias("tier"))


@query("value_entropy", [229], """WITH n AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n)
SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)), 6) >= 1.5 AS low_confidence FROM p GROUP BY user_id""")
def value_entropy(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    entropy = F.round(-F.sum(F.col("p") * F.log("p")), 6)
    return counts.select("user_id", share.alias("p")).groupBy("user_id").agg(entropy.alias("entropy"), (entropy >= 1.5).alias("low_confidence"))


@query("intent_gap", [118], """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, max(event_type) FILTER (WHERE rn = 1) AS best, round((max(n) FILTER (WHERE rn = 1) - coalesce(max(n) FILTER (WHERE rn = 2), 0))::DOUBLE / max(total), 6) AS gap FROM r GROUP BY user_id""")
def intent_gap(spark, sf_dir):
    """The leading candidate and how far the second is behind."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    order = w.orderBy(F.desc("n"), "event_type")
    own = counts.select("user_id", F.col("event_type").alias("best"), ((F.col("n") - F.lead("n", 1, 0).over(order)) / F.sum("n").over(w)).alias("gap"), F.row_number().over(order).alias("rn"))
    return own.filter("rn = 1").select("user_id", "best", F.round("gap", 6).alias("gap"))


@query("scope_candidates", [250], """SELECT o_orderkey, l_partkey AS setter, round(n * (2 - 1.0 / lines), 6) AS salience FROM (SELECT l_orderkey AS o_orderkey, min_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS l_partkey, count(DISTINCT l_partkey) AS n, count(*) AS lines FROM lineitem GROUP BY l_orderkey)""")
def scope_candidates(spark, sf_dir):
    """The first item of a group sets its scope; salience grows with what the group has."""
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    own = own.agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("setter"), F.countDistinct("l_partkey").alias("n"), F.count("*").alias("lines"))
    return own.select("o_orderkey", "setter", F.round(F.col("n") * (2 - 1.0 / F.col("lines")), 6).alias("salience"))


@query("hygiene_actions", [251], """WITH a AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'suppress' WHEN length(p_name) < 8 THEN 'merge' END AS action FROM part)
SELECT coalesce(action, 'keep') AS action, count(*)::BIGINT AS parts, min(p_partkey) AS first FROM a GROUP BY 1""")
def hygiene_actions(spark, sf_dir):
    """Actions of hygiene rules as a table of their own, which can be taken back by leaving it out."""
    parts = read(spark, sf_dir, "part")
    action = F.when(F.col("p_size") > 45, "suppress").when(F.length("p_name") < 8, "merge")
    actions = parts.select("p_partkey", action.alias("action")).filter("action is not null")
    both = parts.select("p_partkey").join(actions, "p_partkey", "left")
    return both.groupBy(F.coalesce("action", F.lit("keep")).alias("action")).agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))


@query("union_of_legs", [132, 133], """SELECT id, max(score) AS score, count(*)::BIGINT AS legs FROM (SELECT o_custkey AS id, round(max(o_totalprice), 2) AS score FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, round(c_acctbal, 2) FROM customer WHERE c_acctbal > 5000) GROUP BY id""")
def union_of_legs(spark, sf_dir):
    one = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.max("o_totalprice"), 2).alias("score"))
    two = read(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("score"))
    return one.unionByName(two).groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("legs"))


@query("plan_states", [370], """SELECT o_orderkey, count(*)::BIGINT AS steps, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS done, bool_and(l_linestatus = 'F') AS complete, count(*) FILTER (WHERE l_returnflag = 'R') > 2 AS replan FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def plan_states(spark, sf_dir):
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = both.groupBy("o_orderkey")
    done = F.col("l_linestatus") == "F"
    return own.agg(F.count("*").alias("steps"), F.count_if(done).alias("done"), F.bool_and(done).alias("complete"), (F.count_if(F.col("l_returnflag") == "R") > 2).alias("replan"))
