"""Facts: lookups, conflicts, duplicates, validity in time, counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import temporal
from ..sources.tables import for_tenant, minute, read
from ..sources.views import FACTS_SQL, facts
from .registry import query

def when():
    return F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")


@query("facts_by_status", [24, 122], f"""WITH {FACTS_SQL}
SELECT fact_id, subject, predicate, round(value, 6) AS value FROM facts WHERE status = 'approved'
ORDER BY valid_from DESC, fact_id DESC LIMIT 100""")
def facts_by_status(spark, sf_dir):
    own = facts(spark, sf_dir).filter("status = 'approved'").orderBy(F.desc("valid_from"), F.desc("fact_id")).limit(100)
    return own.select("fact_id", "subject", "predicate", F.round("value", 6).alias("value"))


@query("facts_by_subject_predicate", [25, 29], f"""WITH {FACTS_SQL}
SELECT fact_id, status, round(value, 6) AS value FROM facts
WHERE tenant_id = 'tenant_3' AND subject = 'user_7' AND predicate = 'purchase'""")
def facts_by_subject_predicate(spark, sf_dir):
    own = for_tenant(facts(spark, sf_dir), "tenant_3").filter("subject = 'user_7' and predicate = 'purchase'")
    return own.select("fact_id", "status", F.round("value", 6).alias("value"))


@query("facts_page", [26, 43], f"""WITH {FACTS_SQL}, own AS (SELECT * FROM facts WHERE status = 'proposed' AND predicate = 'view')
SELECT fact_id, subject, (SELECT count(*) FROM own)::BIGINT AS total FROM own ORDER BY fact_id LIMIT 20 OFFSET 40""")
def facts_page(spark, sf_dir):
    """A page of the rows that the given filters leave, with their number."""
    filters = {"status": "proposed", "predicate": "view", "subject": None}
    own = facts(spark, sf_dir)
    for column, wanted in filters.items():
        if wanted is not None:
            own = own.filter(F.col(column) == wanted)
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy("fact_id").offset(40).limit(20).crossJoin(F.broadcast(total)).select("fact_id", "subject", "total")


@query("fact_conflicts", [44], f"""WITH {FACTS_SQL}
SELECT p.fact_id AS proposed_id, a.fact_id AS approved_id,
       CASE WHEN p.valid_from > a.valid_from THEN 'OVERRIDES' ELSE 'CONTRADICTS' END AS conflict,
       CASE WHEN a.value <> 0 THEN round(abs(p.value - a.value) / abs(a.value), 6) END AS relative_diff
FROM facts a JOIN facts p ON a.tenant_id = p.tenant_id AND a.subject = p.subject AND a.predicate = p.predicate
WHERE a.status = 'approved' AND p.status = 'proposed' AND p.value <> a.value AND p.valid_from >= a.valid_from
  AND (a.valid_until IS NULL OR a.valid_until >= p.valid_from)""")
def fact_conflicts(spark, sf_dir):
    """Proposed facts against the approved facts that are in force when they begin; older ones are outdated and dropped.

    No fact of a key begins between one's valid_from and valid_until, so a fact is in force for those that begin at
    either: an equi-join by key and time, no pairs of all of a key.
    """
    key = ["tenant_id", "subject", "predicate"]
    now = facts(spark, sf_dir)
    approved = now.filter("status = 'approved'").select(
        *key, F.struct("fact_id", "value", "valid_from").alias("a"), F.explode(F.array_distinct(F.array("valid_from", "valid_until"))).alias("valid_from")
    )
    held = now.filter("status = 'proposed'").join(approved, [*key, "valid_from"]).filter("a.value != value")
    return held.select(
        F.col("fact_id").alias("proposed_id"),
        F.col("a.fact_id").alias("approved_id"),
        F.when(F.col("valid_from") > F.col("a.valid_from"), "OVERRIDES").otherwise("CONTRADICTS").alias("conflict"),
        F.when(F.col("a.value") != 0, F.round(F.abs(F.col("value") - F.col("a.value")) / F.abs("a.value"), 6)).alias("relative_diff"),
    )


@query("fact_duplicates", [45], f"""WITH {FACTS_SQL}
SELECT tenant_id, subject, predicate, floor(value)::BIGINT AS rounded, count(*)::BIGINT AS facts,
       count(DISTINCT source_document)::BIGINT AS sources, min(fact_id) AS first_fact
FROM facts WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source_document) > 1""")
def fact_duplicates(spark, sf_dir):
    """Equal statements of several sources, as one row for each statement."""
    own = facts(spark, sf_dir).filter("value is not null").groupBy("tenant_id", "subject", "predicate", F.floor("value").alias("rounded"))
    return own.agg(F.count("*").alias("facts"), F.countDistinct("source_document").alias("sources"), F.min("fact_id").alias("first_fact")).filter("sources > 1")


@query("facts_valid_at", [47], f"""WITH {FACTS_SQL}
SELECT fact_id, subject, predicate, round(value, 6) AS value FROM facts
WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15 12:00:00')""")
def facts_valid_at(spark, sf_dir):
    return temporal.valid_at(facts(spark, sf_dir), when()).select("fact_id", "subject", "predicate", F.round("value", 6).alias("value"))


@query("snapshot_validity", [51], f"""WITH {FACTS_SQL}
SELECT predicate, count(*)::BIGINT AS facts, round(sum(value), 2) AS total FROM facts
WHERE (valid_until IS NULL OR valid_until >= TIMESTAMP '2024-01-15 12:00:00') AND valid_from <= TIMESTAMP '2024-01-15 12:00:00'
GROUP BY predicate""")
def snapshot_validity(spark, sf_dir):
    own = temporal.valid_at(facts(spark, sf_dir), when(), end_inclusive=True)
    return own.groupBy("predicate").agg(F.count("*").alias("facts"), F.round(F.sum("value"), 2).alias("total"))


@query("asof_last_purchase", [47], """SELECT e.event_id, coalesce((
  SELECT max(struct_pack(t := p.ts, i := p.event_id)).i FROM events p
  WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts), -1) AS asof_event_id
FROM events e WHERE e.event_type = 'error'""")
def asof_last_purchase(spark, sf_dir):
    """For each error the user's last purchase until then."""
    events = read(spark, sf_dir, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    joined = temporal.asof_join(errors, purchases, ["user_id"], "ts", "ts", "event_id", ["event_id"])
    return joined.select("event_id", F.coalesce("asof_event_id", F.lit(-1)).alias("asof_event_id"))


@query("temporal_diff", [52], f"""WITH {FACTS_SQL}, moved AS (
  SELECT fact_id, valid_until AS moment FROM facts WHERE valid_until IS NOT NULL)
SELECT change, count(*)::BIGINT AS facts, min(fact_id) AS first_fact FROM (
  SELECT fact_id, 'introduced' AS change FROM facts WHERE valid_from >= TIMESTAMP '2024-01-10' AND valid_from < TIMESTAMP '2024-01-12'
  UNION ALL SELECT fact_id, 'retired' FROM facts WHERE valid_until >= TIMESTAMP '2024-01-10' AND valid_until < TIMESTAMP '2024-01-12'
  UNION ALL SELECT fact_id, 'modified' FROM moved WHERE moment >= TIMESTAMP '2024-01-10' AND moment < TIMESTAMP '2024-01-12')
GROUP BY change""")
def temporal_diff(spark, sf_dir):
    own = facts(spark, sf_dir)
    replaced = own.filter("valid_until is not null").select("fact_id", F.col("valid_until").alias("at"))
    start, end = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in (10, 12))
    changes = temporal.period_changes(own, start, end, "fact_id", replaced)
    return changes.groupBy("change").agg(F.count("*").alias("facts"), F.min("fact_id").alias("first_fact"))


@query("fact_counts", [74, 75], f"""WITH {FACTS_SQL}
SELECT status, predicate, count(*)::BIGINT AS facts, count(*) FILTER (WHERE value > 50)::BIGINT AS high,
       count(DISTINCT subject)::BIGINT AS subjects FROM facts GROUP BY status, predicate""")
def fact_counts(spark, sf_dir):
    own = facts(spark, sf_dir).groupBy("status", "predicate")
    return own.agg(F.count("*").alias("facts"), F.count_if(F.col("value") > 50).alias("high"), F.countDistinct("subject").alias("subjects"))


@query("fact_count_cube", [99], f"""WITH {FACTS_SQL}
SELECT coalesce(status, '*') AS status, coalesce(predicate, '*') AS predicate, count(*)::BIGINT AS facts FROM facts GROUP BY CUBE (status, predicate)""")
def fact_count_cube(spark, sf_dir):
    cube = facts(spark, sf_dir).cube("status", "predicate").agg(F.count("*").alias("facts"))
    return cube.select(F.coalesce("status", F.lit("*")).alias("status"), F.coalesce("predicate", F.lit("*")).alias("predicate"), "facts")


@query("fact_timeline", [109, 121], f"""WITH {FACTS_SQL}
SELECT fact_id, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from,
       round(value - lag(value) OVER (PARTITION BY subject, predicate ORDER BY facts.valid_from, fact_id), 6) AS change,
       row_number() OVER (PARTITION BY subject, predicate ORDER BY facts.valid_from DESC, fact_id DESC)::BIGINT AS place
FROM facts""")
def fact_timeline(spark, sf_dir):
    forward = Window.partitionBy("subject", "predicate").orderBy("valid_from", "fact_id")
    back = Window.partitionBy("subject", "predicate").orderBy(F.desc("valid_from"), F.desc("fact_id"))
    own = facts(spark, sf_dir)
    change, place = F.col("value") - F.lag("value").over(forward), F.row_number().over(back).cast("long")
    return own.select("fact_id", minute(F.col("valid_from")).alias("valid_from"), F.round(change, 6).alias("change"), place.alias("place"))


@query("fact_governance_log", [314, 318], f"""WITH {FACTS_SQL}, log AS (
  SELECT fact_id, subject, status, valid_from AS moment FROM facts
  UNION ALL SELECT fact_id, subject, 'rejected', valid_until FROM facts WHERE status = 'proposed' AND valid_until IS NOT NULL)
SELECT state, count(*)::BIGINT AS facts FROM (
  SELECT fact_id, arg_max(status, moment) AS state FROM log GROUP BY fact_id) GROUP BY state""")
def fact_governance_log(spark, sf_dir):
    """The latest state of each fact from an append-only log: a proposed fact is rejected when the next one comes."""
    own = facts(spark, sf_dir)
    log = own.select("fact_id", "status", F.col("valid_from").alias("at"))
    log = log.unionByName(own.filter("status = 'proposed' and valid_until is not null").select("fact_id", F.lit("rejected").alias("status"), F.col("valid_until").alias("at")))
    return log.groupBy("fact_id").agg(F.max_by("status", "at").alias("state")).groupBy("state").agg(F.count("*").alias("facts"))


@query("fact_validation", [315, 316], f"""WITH {FACTS_SQL}
SELECT fact_id, CASE WHEN value IS NULL THEN 'no value' WHEN value < 0 THEN 'negative'
         WHEN valid_until < valid_from THEN 'empty interval' WHEN source_document IS NULL THEN 'no source' ELSE 'ok' END AS finding,
       strftime(coalesce(valid_until, TIMESTAMP '9999-12-31 00:00:00'), '%Y-%m-%d %H:%M:%S') AS holds_until FROM facts""")
def fact_validation(spark, sf_dir):
    finding = (
        F.when(F.col("value").isNull(), "no value")
        .when(F.col("value") < 0, "negative")
        .when(F.col("valid_until") < F.col("valid_from"), "empty interval")
        .when(F.col("source_document").isNull(), "no source")
        .otherwise("ok")
    )
    until = F.coalesce("valid_until", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    return facts(spark, sf_dir).select("fact_id", finding.alias("finding"), minute(until).alias("holds_until"))


@query("expired_rows", [312], f"""WITH {FACTS_SQL}
SELECT fact_id FROM facts WHERE status = 'proposed' AND valid_until < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY""")
def expired_rows(spark, sf_dir):
    limit = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return facts(spark, sf_dir).filter((F.col("status") == "proposed") & (F.col("valid_until") < limit)).select("fact_id")


@query("overlapping_offers", [44], """WITH f AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS subject, l_suppkey AS source, l_discount AS value, l_returnflag = 'N' AS proposed, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e FROM lineitem)
SELECT p.id AS proposed_id, p.line AS proposed_line, a.id AS approved_id, a.line AS approved_line, p.subject AS subject, round(abs(p.value - a.value), 4) AS apart FROM f p JOIN f a ON p.subject = a.subject AND p.proposed AND NOT a.proposed AND p.s < a.e AND a.s < p.e AND p.source <> a.source AND p.value <> a.value""")
def overlapping_offers(spark, sf_dir):
    """Proposed and approved offers on a part that hold at one time and differ: validities of any lengths, which begin and end where they like."""
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("source"),
        F.col("l_discount").alias("value"), (F.col("l_returnflag") == "N").alias("proposed"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"),
    )
    both = temporal.overlapping(rows.filter("proposed"), rows.filter("not proposed"), ["subject"], "s", "e", 16)
    differ = both.filter("left.source != right.source and left.value != right.value")
    return differ.select(
        F.col("left.id").alias("proposed_id"), F.col("left.line").alias("proposed_line"), F.col("right.id").alias("approved_id"), F.col("right.line").alias("approved_line"),
        F.col("left.subject").alias("subject"), F.round(F.abs(F.col("left.value") - F.col("right.value")), 4).alias("apart"),
    )
