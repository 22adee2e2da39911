"""Keys of a stream share state by groups; the result is that of each key alone."""

import time

import pytest
from pyspark.sql import functions as F

from factweave.streaming import events as S
from factweave.streaming import keyed as K


def requests(spark, place, users):
    rows = spark.range(users * 4).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % users == 0, None).otherwise(F.col("id") % users).alias("user_id"), F.lit("a\"b").alias("kind"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), (F.col("id") % 3).cast("double").alias("value"),
    )
    rows.coalesce(1).write.parquet(place)
    return S.event_stream(spark, place)


@pytest.mark.parametrize("groups", [1, 7])
def test_groups_don_t_matter(spark, tmp_path, groups):
    stream = requests(spark, str(tmp_path / "events"), 20)
    payload = F.col("value").cast("string")
    found = K.keyed(stream, K.Requests(["user_id", "kind"], 30 * K.SECOND), payload, "us long, event_id long, outcome string, answered_by long", "10 seconds", groups)
    assert found.columns == ["user_id", "kind", "us", "event_id", "outcome", "answered_by"]
    got = sorted((r.event_id, r.user_id, r.kind, r.outcome, r.answered_by) for r in K.run_to_end(found, f"g{groups}").collect())
    want = []
    for user in range(20):
        own, out = K.Requests([], 30 * K.SECOND).fresh(), []
        one = K.Requests([], 30 * K.SECOND)
        for i in range(user, 70, 20):  # rows of the last ten seconds wait
            us = (1_700_000_000 + i) * K.SECOND
            own = one.take(one.wake(own, us, out), us, i, f"{i % 3}.0", out)
        want += [(e, user or None, 'a"b', outcome, by) for _, e, outcome, by in out]
    assert got == sorted(want)


def test_many_keys_take_few_calls(spark, tmp_path):
    stream = requests(spark, str(tmp_path / "events"), 12_000)
    start = time.time()
    found = K.run_to_end(K.idempotent_requests(stream, ["user_id", "kind"], F.col("value"), 30, "10 seconds"), "many")
    assert found.count() == 48_000 - 10
    assert time.time() - start < 45
