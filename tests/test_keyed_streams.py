"""Circuits and reservations: what rows and time do to them, and that the result doesn't depend on how rows come in batches."""

import random

from pyspark.sql import functions as F

from factweave.streaming import events as S
from factweave.streaming import keyed as K

CIRCUIT = K.Breaker(["k"], 3, 100, 50)


def replay(processor, rows, until):
    """What a processor says about the rows (us, event_id, payload) of a key, and then about the time."""
    own, out = processor.fresh(), []
    for us, event_id, payload in sorted(rows):
        own = processor.take(processor.wake(own, us, out), us, event_id, payload, out)
    return processor.wake(own, until, out), out


def changes(rows, until=0):
    return [(us, now) for us, _, now, *_ in replay(CIRCUIT, [(t, i, p) for i, (t, p) in enumerate(rows)], until)[1]]


def test_failures_within_the_window_open_a_circuit():
    assert changes([(1, "bad"), (2, "bad"), (3, "bad")]) == [(3, "OPEN")]
    assert changes([(1, "bad"), (2, "bad"), (3, "good"), (4, "bad")]) == [(4, "OPEN")]  # a success forgets nothing
    assert changes([(1, "bad"), (2, "bad"), (101, "bad")]) == []  # the first is out of the window
    assert changes([(1, "bad"), (2, "bad"), (100, "bad")]) == [(100, "OPEN")]


def test_a_half_open_circuit_closes_or_opens_again():
    opened = [(1, "bad"), (2, "bad"), (3, "bad")]
    assert changes(opened, 52) == [(3, "OPEN")]
    assert changes(opened, 53) == [(3, "OPEN"), (53, "HALF_OPEN")]
    assert changes([*opened, (60, "good"), (61, "bad")]) == [(3, "OPEN"), (53, "HALF_OPEN"), (60, "CLOSED")]
    assert changes([*opened, (60, "bad"), (70, "good")], 110) == [(3, "OPEN"), (53, "HALF_OPEN"), (60, "OPEN"), (110, "HALF_OPEN")]


def test_an_open_circuit_refuses_calls():
    own, out = replay(CIRCUIT, [(1, 1, "bad"), (2, 2, "bad"), (3, 3, "bad"), (4, 4, "bad"), (52, 5, "good")], 60)
    assert out[-1] == (53, "OPEN", "HALF_OPEN", 3, 2)
    assert own[0] == "HALF_OPEN"


def test_reservations():
    requests = K.Requests(["k"], 100)
    own, out = replay(requests, [(0, 1, "x"), (5, 2, "x"), (6, 3, "y"), (99, 4, "x"), (100, 5, "y"), (150, 6, "y")], 150)
    assert [(e, o, by) for _, e, o, by in out] == [(1, "RESERVED", 1), (2, "STORED", 1), (3, "CONFLICT", 1), (4, "STORED", 1), (5, "RESERVED", 5), (6, "STORED", 5)]
    assert requests.due(own) == 200
    assert replay(requests, [(0, 1, "x")], 100)[0] == requests.fresh()


def test_batches_don_t_matter(spark, tmp_path):
    """The same events in one file, and mixed up over six files that are read one by one, where no row is later than the delay."""
    rng = random.Random(2)
    events = [(i, 1_700_000_000 + 60 * i, rng.randrange(3), rng.choice(["error", "view"]), float(rng.randrange(3))) for i in range(240)]
    df = spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    for n in range(6):
        some = [e[0] for e in events if min(5, max(0, (e[0] + (e[0] * 7) % 15) // 40)) == n]
        df.filter(F.col("event_id").isin(some)).coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))

    def transitions(name, files):
        stream = S.event_stream(spark, str(tmp_path / name), files)
        return sorted(map(tuple, K.run_to_end(K.breaker_transitions(stream, ["user_id"], F.col("event_type") == "error", 3, 600, 1200, "30 minutes"), f"t-{name}").collect()))

    def outcomes(name, files):
        stream = S.event_stream(spark, str(tmp_path / name), files)
        return sorted(map(tuple, K.run_to_end(K.idempotent_requests(stream, ["user_id"], F.col("value"), 1800, "30 minutes"), f"r-{name}").collect()))

    one = transitions("one", 16)
    assert one and transitions("many", 1) == one
    want = []
    passed = (max(e[1] for e in events) - 1800) * K.SECOND
    for user in range(3):
        rows = [(s * K.SECOND, i, "bad" if kind == "error" else "good") for i, s, u, kind, _ in events if u == user and s * K.SECOND <= passed]
        want += [(user, *r) for r in replay(K.Breaker(["user_id"], 3, 600 * K.SECOND, 1200 * K.SECOND), rows, passed)[1]]
    assert one == sorted(want)
    assert outcomes("one", 16) == outcomes("many", 1) != []
