"""Claims about a subject from several sources: maturity, importance, tiers, contradictions, verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read
from ..sources.views import OFFERS_SQL, offers
from .registry import query


@query("claim_consolidation", [76, 78], f"""WITH {OFFERS_SQL}, g AS (
  SELECT subject, claim_type, scope, count(*) AS n, count(DISTINCT source_doc) AS docs, min(value) AS lo, max(value) AS hi, avg(CASE WHEN hedge > 0.05 THEN 1.0 ELSE 0.0 END) AS hedged
  FROM offers GROUP BY ALL)
SELECT sha256(subject || '|' || claim_type || '|' || scope) AS canonical_id, n::BIGINT AS claims, docs::BIGINT AS docs,
  CASE WHEN hedged > 0.7 THEN 'CONTEXT_DEPENDENT' WHEN hi - lo >= 0.05 * hi THEN 'CONFLICTING' WHEN docs >= 2 THEN 'VALIDATED' ELSE 'CANDIDATE' END AS maturity FROM g""")
def claim_consolidation(spark, sf_dir):
    """Claims of one subject, type and scope as one canonical claim with its maturity; the first state that fits counts."""
    own = offers(spark, sf_dir).groupBy("subject", "claim_type", "scope").agg(
        F.count("*").alias("claims"),
        F.countDistinct("source_doc").alias("docs"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.avg((F.col("hedge") > 0.05).cast("double")).alias("hedged"),
    )
    maturity = (
        F.when(F.col("hedged") > 0.7, "CONTEXT_DEPENDENT")
        .when(F.col("hi") - F.col("lo") >= 0.05 * F.col("hi"), "CONFLICTING")
        .when(F.col("docs") >= 2, "VALIDATED")
        .otherwise("CANDIDATE")
    )
    key = F.sha2(F.concat_ws("|", F.col("subject").cast("string"), "claim_type", "scope"), 256)
    return own.select(key.alias("canonical_id"), "claims", "docs", maturity.alias("maturity"))


@query("relation_consolidation", [77], f"""WITH {OFFERS_SQL}, t AS (SELECT subject, claim_type, count(*) AS n FROM offers GROUP BY ALL),
r AS (SELECT subject, claim_type, n, sum(n) OVER (PARTITION BY subject) AS total, row_number() OVER (PARTITION BY subject ORDER BY n DESC, claim_type) AS rn,
  n - lead(n, 1, 0) OVER (PARTITION BY subject ORDER BY n DESC, claim_type) AS gap FROM t)
SELECT subject, claim_type, round(n::DOUBLE / total, 6) AS share, CASE WHEN gap::DOUBLE / total < 0.15 THEN 'AMBIGUOUS_TYPE' WHEN n >= 2 THEN 'VALIDATED' ELSE 'CANDIDATE' END AS state FROM r WHERE rn = 1""")
def relation_consolidation(spark, sf_dir):
    """The leading type of each subject, ambiguous if the next one is near."""
    counts = offers(spark, sf_dir).groupBy("subject", "claim_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("subject").orderBy(F.desc("n"), "claim_type")
    own = counts.select("subject", "claim_type", "n", F.sum("n").over(Window.partitionBy("subject")).alias("total"), F.row_number().over(order).alias("rn"), (F.col("n") - F.lead("n", 1, 0).over(order)).alias("gap"))
    state = F.when(F.col("gap") / F.col("total") < 0.15, "AMBIGUOUS_TYPE").when(F.col("n") >= 2, "VALIDATED").otherwise("CANDIDATE")
    return own.filter("rn = 1").select("subject", "claim_type", F.round(F.col("n") / F.col("total"), 6).alias("share"), state.alias("state"))


IMPORTANCE_SQL = f"""{OFFERS_SQL}, m AS (SELECT subject, count(*) AS claims, count(DISTINCT source_doc) AS docs, count(DISTINCT claim_type) AS degree FROM offers GROUP BY subject),
i AS (SELECT *, round(ln(1 + claims) + 1.5 * ln(1 + docs) + 0.5 * degree, 3) AS importance FROM m)"""


def importance(spark, sf_dir):
    own = offers(spark, sf_dir).groupBy("subject").agg(
        F.count("*").alias("claims"), F.countDistinct("source_doc").alias("docs"), F.countDistinct("claim_type").alias("degree")
    )
    score = F.log1p("claims") + 1.5 * F.log1p("docs") + 0.5 * F.col("degree")
    return own.withColumn("importance", F.round(score, 3))


@query("importance_score", [80], f"WITH {IMPORTANCE_SQL} SELECT subject, claims::BIGINT AS claims, docs::BIGINT AS docs, importance FROM i")
def importance_score(spark, sf_dir):
    return importance(spark, sf_dir).select("subject", "claims", "docs", "importance")


@query("importance_tiers", [102], f"""WITH {IMPORTANCE_SQL}, n AS (SELECT count(*) AS n FROM i), t AS (SELECT importance, count(*) AS c, sum(count(*)) OVER (ORDER BY importance DESC) AS upto FROM i GROUP BY importance)
SELECT subject, importance, CASE WHEN upto <= greatest(1, 0.05 * n) AND docs >= 2 THEN 1 WHEN upto <= 0.2 * n THEN 2 ELSE 3 END::BIGINT AS tier FROM i JOIN t USING (importance) CROSS JOIN n""")
def importance_tiers(spark, sf_dir):
    """Tiers by how many subjects are at least as important: counted for each value of the rounded score, of which there are few."""
    own = importance(spark, sf_dir)
    values = own.groupBy("importance").agg(F.count("*").alias("c"))
    upto = values.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("importance")))).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    tier = F.when((F.col("upto") <= F.greatest(F.lit(1), 0.05 * F.col("n"))) & (F.col("docs") >= 2), 1).when(F.col("upto") <= 0.2 * F.col("n"), 2).otherwise(3)
    return own.join(upto, "importance").select("subject", "importance", tier.cast("long").alias("tier"))


@query("hub_scores", [82], """WITH s AS (SELECT l_suppkey AS hub, count(DISTINCT l_partkey) AS spread, count(*) AS freq FROM lineitem GROUP BY 1),
p AS (SELECT quantile_cont(spread, 0.95) AS ps, quantile_cont(freq, 0.95) AS pf FROM s)
SELECT hub, round(least(greatest(0.5 * spread / ps + 0.5 * freq / pf - 0.2, 0), 1), 6) AS score FROM s CROSS JOIN p""")
def hub_scores(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("hub")).agg(F.countDistinct("l_partkey").alias("spread"), F.count("*").alias("freq"))
    at = own.agg(F.percentile("spread", 0.95).alias("ps"), F.percentile("freq", 0.95).alias("pf"))
    score = T.clamp(0.5 * F.col("spread") / F.col("ps") + 0.5 * F.col("freq") / F.col("pf") - 0.2)
    return own.crossJoin(F.broadcast(at)).select("hub", F.round(score, 6).alias("score"))


@query("evidence_tiers", [83, 84, 86], f"""WITH {OFFERS_SQL}, c AS (SELECT subject, count(*) AS n FROM offers GROUP BY subject)
SELECT tier, count(*)::BIGINT AS subjects, round(avg(strength), 6) AS strength FROM (
  SELECT CASE WHEN n >= 30 THEN 'HIGH' WHEN n >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS tier, least(1, 0.3 + 0.1 * log2(n)) AS strength FROM c) GROUP BY tier""")
def evidence_tiers(spark, sf_dir):
    own = offers(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"))
    tier = F.when(F.col("n") >= 30, "HIGH").when(F.col("n") >= 20, "MEDIUM").otherwise("LOW")
    strength = F.least(F.lit(1.0), 0.3 + 0.1 * F.log2("n"))
    return own.select(tier.alias("tier"), strength.alias("s")).groupBy("tier").agg(F.count("*").alias("subjects"), F.round(F.avg("s"), 6).alias("strength"))


@query("promotion_grades", [79], f"""WITH {OFFERS_SQL}, g AS (SELECT subject, count(*) AS support, count(DISTINCT source_doc) AS docs, count(DISTINCT claim_type) AS kinds, median(hedge) AS hedge FROM offers GROUP BY subject)
SELECT subject, CASE WHEN support < 5 THEN 'rejected' WHEN docs >= 10 AND kinds >= 3 AND hedge <= 0.05 THEN 'strict' WHEN docs >= 5 AND kinds >= 2 THEN 'extended' ELSE 'kept' END AS grade, round(hedge, 6) AS hedge FROM g""")
def promotion_grades(spark, sf_dir):
    own = offers(spark, sf_dir).groupBy("subject").agg(
        F.count("*").alias("support"), F.countDistinct("source_doc").alias("docs"), F.countDistinct("claim_type").alias("kinds"), F.median("hedge").alias("hedge")
    )
    grade = (
        F.when(F.col("support") < 5, "rejected")
        .when((F.col("docs") >= 10) & (F.col("kinds") >= 3) & (F.col("hedge") <= 0.05), "strict")
        .when((F.col("docs") >= 5) & (F.col("kinds") >= 2), "extended")
        .otherwise("kept")
    )
    return own.select("subject", grade.alias("grade"), F.round("hedge", 6).alias("hedge"))


@query("divergence_clusters", [245, 362], f"""WITH {OFFERS_SQL} SELECT subject, claim_type, count(*)::BIGINT AS claims, count(DISTINCT scope)::BIGINT AS scopes, round(max(value) - min(value), 1) AS spread
FROM offers GROUP BY subject, claim_type HAVING count(DISTINCT scope) > 1 AND count(*) >= 2""")
def divergence_clusters(spark, sf_dir):
    own = offers(spark, sf_dir).groupBy("subject", "claim_type")
    own = own.agg(F.count("*").alias("claims"), F.countDistinct("scope").alias("scopes"), F.round(F.max("value") - F.min("value"), 1).alias("spread"))
    return own.filter("scopes > 1 and claims >= 2")


@query("polarity_conflicts", [46, 342, 343], f"""WITH {OFFERS_SQL} SELECT subject, count(DISTINCT source_doc) FILTER (WHERE claim_type = 'A')::BIGINT AS for_docs, count(DISTINCT source_doc) FILTER (WHERE claim_type = 'R')::BIGINT AS against_docs
FROM offers WHERE hedge <= 0.08 GROUP BY subject HAVING for_docs > 0 AND against_docs > 0""")
def polarity_conflicts(spark, sf_dir):
    """Subjects that some documents affirm and others deny, with how many of each; no pairs are listed."""
    docs = lambda kind: F.count_distinct(F.when(F.col("claim_type") == kind, F.col("source_doc")))
    own = offers(spark, sf_dir).filter("hedge <= 0.08").groupBy("subject").agg(docs("A").alias("for_docs"), docs("R").alias("against_docs"))
    return own.filter("for_docs > 0 and against_docs > 0")


@query("signature_comparison", [70, 241], f"""WITH {OFFERS_SQL}, v AS (SELECT subject, source_doc, round(value, 0) AS v, scope, lag(round(value, 0)) OVER w AS pv, lag(source_doc) OVER w AS pd, claim_id
  FROM offers WINDOW w AS (PARTITION BY subject, claim_type ORDER BY stated_at, claim_id, source_doc, value))
SELECT CASE WHEN v = pv AND source_doc = pd THEN 'AGREEMENT' WHEN v = pv THEN 'CONVERGENCE' WHEN source_doc = pd THEN 'CONTRADICTION' ELSE 'EVOLUTION' END AS relation, count(*)::BIGINT AS pairs
FROM v WHERE pv IS NOT NULL GROUP BY 1""")
def signature_comparison(spark, sf_dir):
    """Each statement against the one before it on the same question."""
    w = Window.partitionBy("subject", "claim_type").orderBy("stated_at", "claim_id", "source_doc", "value")
    now = F.round("value", 0)
    own = offers(spark, sf_dir).select("source_doc", now.alias("v"), F.lag(now).over(w).alias("pv"), F.lag("source_doc").over(w).alias("pd")).filter("pv is not null")
    same_value, same_doc = F.col("v") == F.col("pv"), F.col("source_doc") == F.col("pd")
    relation = F.when(same_value & same_doc, "AGREEMENT").when(same_value, "CONVERGENCE").when(same_doc, "CONTRADICTION").otherwise("EVOLUTION")
    return own.groupBy(relation.alias("relation")).agg(F.count("*").alias("pairs"))


@query("value_tolerance", [235], f"""WITH {OFFERS_SQL}, m AS (SELECT subject, avg(value) AS ref FROM offers GROUP BY subject)
SELECT verdict, count(*)::BIGINT AS claims FROM (SELECT CASE WHEN abs(value - ref) <= least(0.02 * (1 + 0.5 * hedge), 0.1) * ref THEN 'SUPPORTS' WHEN abs(value - ref) <= 0.5 * ref THEN 'PARTIAL' ELSE 'CONTRADICTS' END AS verdict
  FROM offers JOIN m USING (subject)) GROUP BY verdict""")
def value_tolerance(spark, sf_dir):
    """Each value against its subject's mean, with a tolerance that hedging widens, 10 % at most."""
    own = offers(spark, sf_dir)
    both = own.join(own.groupBy("subject").agg(F.avg("value").alias("ref")), "subject")
    off = F.abs(F.col("value") - F.col("ref"))
    tolerance = F.least(0.02 * (1 + 0.5 * F.col("hedge")), F.lit(0.1)) * F.col("ref")
    verdict = F.when(off <= tolerance, "SUPPORTS").when(off <= 0.5 * F.col("ref"), "PARTIAL").otherwise("CONTRADICTS")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("claims"))


@query("marker_diff", [130], """WITH m AS (SELECT l_partkey AS marker, bool_or(l_shipmode_a) AS a, bool_or(l_shipmode_b) AS b FROM (
  SELECT l_partkey, l_returnflag = 'A' AS l_shipmode_a, l_returnflag = 'R' AS l_shipmode_b FROM lineitem) GROUP BY 1)
SELECT marker, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only A' ELSE 'only R' END AS side FROM m WHERE a OR b""")
def marker_diff(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("marker"))
    sides = own.agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b")).filter("a or b")
    return sides.select("marker", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only A").otherwise("only R").alias("side"))


@query("claim_evolution", [131], """WITH s AS (SELECT o_custkey AS doc, l_partkey AS key, l_quantity AS object, o_orderdate < TIMESTAMP '1996-01-01' AS old, row_number() OVER (PARTITION BY o_custkey, l_partkey, l_quantity, o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderkey, l_linenumber) AS i
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT change, count(*)::BIGINT AS claims FROM (SELECT CASE WHEN a.doc IS NOT NULL AND b.doc IS NOT NULL THEN 'UNCHANGED' WHEN a.doc IS NOT NULL THEN 'REMOVED' ELSE 'ADDED' END AS change
  FROM (SELECT * FROM s WHERE old) a FULL JOIN (SELECT * FROM s WHERE NOT old) b ON a.doc = b.doc AND a.key = b.key AND a.object = b.object AND a.i = b.i) GROUP BY change""")
def claim_evolution(spark, sf_dir):
    """Statements of two versions paired by subject, predicate and object, the i-th with the i-th."""
    cut = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") < cut).alias("old"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    # Paired are as many as the smaller side has, so counts of each side suffice.
    sides = both.groupBy("o_custkey", "l_partkey", "l_quantity").agg(F.count_if("old").alias("a"), F.count_if(~F.col("old")).alias("b"))
    kinds = sides.select(
        F.explode(
            F.array(
                F.struct(F.lit("UNCHANGED").alias("change"), F.least("a", "b").alias("n")),
                F.struct(F.lit("REMOVED").alias("change"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n")),
                F.struct(F.lit("ADDED").alias("change"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("n")),
            )
        ).alias("k")
    )
    return kinds.groupBy("k.change").agg(F.sum("k.n").alias("claims")).filter("claims > 0")


@query("bubble_metrics", [334, 339], f"""WITH {OFFERS_SQL} SELECT subject, count(*)::BIGINT AS claims, count(DISTINCT source_doc)::BIGINT AS docs,
  (count(*) FILTER (WHERE claim_type = 'R'))::BIGINT AS contradictions, round(avg(1 - hedge) + 1e-9, 3) AS trust, max(stated_at) >= TIMESTAMP '1998-01-01' AS recent FROM offers GROUP BY subject HAVING count(*) >= 3""")
def bubble_metrics(spark, sf_dir):
    own = offers(spark, sf_dir).groupBy("subject").agg(
        F.count("*").alias("claims"),
        F.countDistinct("source_doc").alias("docs"),
        F.count_if(F.col("claim_type") == "R").alias("contradictions"),
        F.round(F.avg(1 - F.col("hedge")) + 1e-9, 3).alias("trust"),
        (F.max("stated_at") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).alias("recent"),
    )
    return own.filter("claims >= 3")


@query("epistemic_state", [97, 281], f"""WITH {OFFERS_SQL}, g AS (SELECT subject, count(DISTINCT claim_type) AS kinds, count(DISTINCT source_doc) AS docs, stddev_pop(value) / avg(value) AS cv FROM offers GROUP BY subject)
SELECT state, count(*)::BIGINT AS subjects FROM (SELECT CASE WHEN docs = 1 THEN 'ORPHAN' WHEN cv > 0.5 THEN 'CONTESTED' WHEN kinds >= 3 AND docs >= 10 THEN 'ESTABLISHED' ELSE 'EMERGING' END AS state FROM g) GROUP BY state""")
def epistemic_state(spark, sf_dir):
    own = offers(spark, sf_dir).groupBy("subject").agg(
        F.countDistinct("claim_type").alias("kinds"), F.countDistinct("source_doc").alias("docs"), (F.stddev_pop("value") / F.avg("value")).alias("cv")
    )
    state = F.when(F.col("docs") == 1, "ORPHAN").when(F.col("cv") > 0.5, "CONTESTED").when((F.col("kinds") >= 3) & (F.col("docs") >= 10), "ESTABLISHED").otherwise("EMERGING")
    return own.groupBy(state.alias("state")).agg(F.count("*").alias("subjects"))


@query("label_metrics", [96, 322], """WITH p AS (SELECT doc_id, toxic = 1 AS truth, len(regexp_extract_all(lower(text), 'stupid|worthless|idiot|hate')) > 0 AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn FROM p)
SELECT round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def label_metrics(spark, sf_dir):
    """Precision, recall and F1 of a word rule against labels."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    said = T.count_matches(F.lower("text"), "stupid|worthless|idiot|hate") > 0
    both = docs.select("doc_id", said.alias("said")).join(labels.select("doc_id", (F.col("toxic") == 1).alias("truth")), "doc_id")
    n = both.agg(F.count_if(F.expr("truth and said")).alias("tp"), F.count_if(F.expr("not truth and said")).alias("fp"), F.count_if(F.expr("truth and not said")).alias("fn"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    f1 = F.round(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6)
    return n.select(ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), f1.alias("f1"))
