"""Queries that run as streams over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import minute
from ..streaming import events as S
from ..streaming import keyed as K
from .registry import query


@query("stream_tumbling_counts", [2, 3, 301], """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling_counts(spark, sf_dir):
    counts = S.run_available(S.tumbling_counts(S.event_stream(spark, f"{sf_dir}/event[s].parquet"), "1 hour"), "tumbling", "complete")
    return counts.select(minute(F.col("start")).alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("stream_distinct_requests", [300], """SELECT count(DISTINCT (user_id, event_type, value))::BIGINT AS requests FROM events""")
def stream_distinct_requests(spark, sf_dir):
    """Requests of one key within the stream's whole length count once."""
    rows = S.distinct_requests(S.event_stream(spark, f"{sf_dir}/event[s].parquet"), ["user_id", "event_type", "value"], "60 days")
    return S.run_available(rows, "distinct", "append").agg(F.count("*").alias("requests"))


@query("stream_circuit_breaker", [299], """WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, count(*) AS n FROM e WHERE bad GROUP BY user_id, island)
SELECT u.user_id, coalesce(sum(n), 0)::BIGINT AS failures, count(*) FILTER (WHERE n >= 2)::BIGINT AS opened FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY u.user_id""")
def stream_circuit_breaker(spark, sf_dir):
    """The last state of each user's circuit."""
    states = S.circuit_breaker(S.event_stream(spark, f"{sf_dir}/event[s].parquet"))
    place = S.shared_folder(spark, "breaker")
    started = (
        states.writeStream.option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).outputMode("update")
        .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{place}/rows")).start()
    )
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
    rows = spark.read.parquet(f"{place}/rows")
    latest = rows.groupBy("user_id").agg(F.max_by(F.struct("failures", "opened"), "batch").alias("s"))
    return latest.select("user_id", "s.failures", "s.opened")


#: Three failures within three days open a circuit for twelve hours; rows may come an hour late, and what is not an hour old yet waits.
DAY = 86_400
DUE_SQL = "due AS (SELECT * FROM events WHERE epoch_us(ts) <= 1000 * ((SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000))"


@query("stream_breaker_transitions", [299], f"""WITH RECURSIVE {DUE_SQL}, e AS (SELECT user_id, epoch_us(ts) AS us, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM due),
step AS (SELECT user_id, 0::BIGINT AS n, 'CLOSED' AS state, 0::BIGINT AS opened, []::BIGINT[] AS failures, 0::BIGINT AS refused, NULL::STRUCT(us BIGINT, was VARCHAR, now VARCHAR, failures BIGINT, refused BIGINT)[] AS said FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, n, CASE WHEN st = 'OPEN' THEN 'OPEN' WHEN bad AND (st = 'HALF_OPEN' OR len(recent) + 1 >= 3) THEN 'OPEN' WHEN NOT bad AND st = 'HALF_OPEN' THEN 'CLOSED' ELSE st END,
   CASE WHEN st <> 'OPEN' AND bad AND (st = 'HALF_OPEN' OR len(recent) + 1 >= 3) THEN us WHEN st = 'HALF_OPEN' THEN 0 ELSE opened END,
   CASE WHEN st = 'OPEN' THEN failures WHEN NOT bad AND st = 'HALF_OPEN' THEN []::BIGINT[] WHEN bad THEN list_append(recent, us) ELSE recent END,
   CASE WHEN st = 'OPEN' THEN refused + 1 ELSE 0 END,
   list_filter([CASE WHEN woke THEN struct_pack(us := opened + 43200000000, was := 'OPEN', now := 'HALF_OPEN', failures := len(failures)::BIGINT, refused := refused) END,
     CASE WHEN st <> 'OPEN' AND bad AND (st = 'HALF_OPEN' OR len(recent) + 1 >= 3) THEN struct_pack(us := us, was := st, now := 'OPEN', failures := len(recent)::BIGINT + 1, refused := 0::BIGINT)
          WHEN st = 'HALF_OPEN' AND NOT bad THEN struct_pack(us := us, was := st, now := 'CLOSED', failures := len(recent)::BIGINT, refused := 0::BIGINT) END], lambda x: x IS NOT NULL)
  FROM (SELECT s.user_id, e.n, e.us, e.bad, s.opened, s.failures, s.refused, list_filter(s.failures, lambda f: f > e.us - 259200000000) AS recent, s.state = 'OPEN' AND e.us >= s.opened + 43200000000 AS woke,
    CASE WHEN s.state = 'OPEN' AND e.us >= s.opened + 43200000000 THEN 'HALF_OPEN' ELSE s.state END AS st FROM step s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)),
last AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, x.us AS us, x.was AS was, x.now AS now, x.failures AS failures, x.refused AS refused FROM (SELECT user_id, unnest(said) AS x FROM step)
UNION ALL SELECT user_id, opened + 43200000000, 'OPEN', 'HALF_OPEN', len(failures), refused FROM last WHERE state = 'OPEN' AND opened + 43200000000 <= 1000 * ((SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000)""")
def stream_breaker_transitions(spark, sf_dir):
    """Each change of a user's circuit: failures in a sliding window open it, after a cooldown one call decides whether it closes."""
    stream = S.event_stream(spark, f"{sf_dir}/event[s].parquet")
    return K.run_to_end(K.breaker_transitions(stream, ["user_id"], F.col("event_type") == "error", 3, 3 * DAY, DAY // 2, "1 hour"), "breaker-transitions")


@query("stream_idempotency", [300], f"""WITH RECURSIVE {DUE_SQL}, e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, floor(value / 40)::BIGINT AS payload, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM due),
step AS (SELECT user_id, event_type, n, us, event_id, payload AS held, event_id AS first, us AS since, 'RESERVED' AS outcome FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_type, e.n, e.us, e.event_id, CASE WHEN e.us >= since + 86400000000 THEN e.payload ELSE held END, CASE WHEN e.us >= since + 86400000000 THEN e.event_id ELSE first END, CASE WHEN e.us >= since + 86400000000 THEN e.us ELSE since END,
  CASE WHEN e.us >= since + 86400000000 THEN 'RESERVED' WHEN e.payload = held THEN 'STORED' ELSE 'CONFLICT' END FROM step s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.n = s.n + 1)
SELECT user_id, event_type, us, event_id, outcome, first AS answered_by FROM step""")
def stream_idempotency(spark, sf_dir):
    """A key (user and kind of event) is reserved for a day by its first request; the same payload (amount class) gets that one, another is a conflict."""
    stream = S.event_stream(spark, f"{sf_dir}/event[s].parquet")
    return K.run_to_end(K.idempotent_requests(stream, ["user_id", "event_type"], F.floor(F.col("value") / 40), DAY, "1 hour"), "idempotency")
