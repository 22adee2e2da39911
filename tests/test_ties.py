"""Queries on rows that share a time, against their SQL."""

import datetime as dt

import duckdb

from factweave.plans import registry

registry.load()


def test_fact_conflicts_with_equal_times(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (2, 1, 10.0), (4, 2, 20.0), (5, 2, 30.0),  # approved at day 1, approved and proposed at day 2
        (6, 3, 1.0), (8, 3, 2.0), (10, 3, 3.0), (7, 3, 4.0), (9, 3, 4.0),  # several of each at one time
        (11, 4, 5.0), (12, 4, 0.0), (13, 5, None), (14, 5, 6.0), (15, 6, 7.0),
    ]
    events = [(i, day(d), 1, "view", v, '{"k": 1}') for i, d, v in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.sql(registry.ORACLE_SQL["fact_conflicts"]).fetchall())
    got = sorted(map(tuple, registry.QUERIES["fact_conflicts"](spark, str(tmp_path)).collect()))
    assert got == want
    assert {(5, 2), (7, 6), (7, 8), (7, 10)} <= {r[:2] for r in got}
