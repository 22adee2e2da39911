"""Keyed state machines over event streams: circuit breaker and idempotent requests.

Keys are dealt to groups by their hash, and a group is what Spark keeps state
for: a call from the JVM then serves many keys, not one. Rows of a group wait in
its state until the watermark has passed them and are then taken key by key in
the order of their times, so that a result doesn't depend on how rows come in
batches; rows later than the watermark are dropped by Spark, and what it has not
passed yet waits. An event-time timer wakes a group when its next row is due,
when a circuit's cooldown ends and when a reservation expires.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder, ship_package

SECOND = 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups to which keys are dealt: each call of a group waits for its state several times, however few its rows are.
GROUPS = 256
WAITING = pa.schema([("key", pa.string()), ("us", pa.int64()), ("event_id", pa.int64()), ("payload", pa.string())])


def as_bytes(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(pa.Table.from_pandas(rows[WAITING.names], WAITING, preserve_index=False))
    return sink.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """Takes the rows (key, us, event_id, payload) of each key of a group in order as the watermark passes them.

    Subclasses say in take() what a row does to what a key has (a tuple), in
    wake() what time alone does, and in due() when time does it. Keys that have
    what they began with are not kept.
    """

    keys: list[str] = []
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.value = handle.getValueState("own", "held string")

    def fresh(self) -> tuple:
        raise NotImplementedError

    def take(self, own: tuple, us: int, event_id: int, payload: str, out: list[tuple]) -> tuple:
        raise NotImplementedError

    def wake(self, own: tuple, us: int, out: list[tuple]) -> tuple:
        raise NotImplementedError

    def due(self, own: tuple) -> int | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.pending.appendValue((as_bytes(frame),))
                least = int(frame["us"].min())
                first = least if first is None else min(first, least)
        if first is None:
            return
        if first <= self._passed(timerValues):
            yield self._go_on(timerValues)
        else:
            self._set_timer(min([-(-first // 1000), *self.handle.listTimers()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._go_on(timerValues)

    def _passed(self, timerValues) -> int:
        return max(0, timerValues.getCurrentWatermarkInMs()) * 1000

    def _go_on(self, timerValues) -> pd.DataFrame:
        passed = self._passed(timerValues)
        chunks = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in self.pending.get()]
        rows = pa.concat_tables(chunks).to_pandas() if chunks else pd.DataFrame(columns=WAITING.names)
        later = rows[rows["us"] > passed]
        now = rows[rows["us"] <= passed].sort_values(["us", "event_id", "payload"])
        held = {k: tuple(own) for k, own in json.loads(self.value.get()[0])} if self.value.exists() else {}
        fresh, found = self.fresh(), []
        said: list[tuple] = []
        for key, us, event_id, payload in zip(*(now[c].tolist() for c in WAITING.names)):
            held[key] = self.take(self.wake(held.get(key, fresh), us, said), us, event_id, payload, said)
            if said:
                found += [(key, *r) for r in said]
                said.clear()
        kept = {}
        for key, own in held.items():
            own = self.wake(own, passed, said)
            if said:
                found += [(key, *r) for r in said]
                said.clear()
            if own != fresh:
                kept[key] = own
        if len(now):
            self.pending.clear()
            if len(later):
                self.pending.appendValue((as_bytes(later),))
        if kept:
            self.value.update((json.dumps(list(kept.items())),))
        elif held:
            self.value.clear()
        dues = [us for us in map(self.due, kept.values()) if us is not None]
        if len(later):
            dues.append(int(later["us"].min()))
        self._set_timer(-(-min(dues) // 1000) if dues else None)
        return pd.DataFrame(found, columns=["key", *self.columns])

    def _set_timer(self, time: int | None) -> None:
        before = set(self.handle.listTimers())
        for t in before - {time}:
            self.handle.deleteTimer(t)
        if time is not None and time not in before:
            self.handle.registerTimer(time)

    def close(self) -> None:
        pass


class Breaker(InOrder):
    """A circuit for each key. payload: "bad" for a failed call, else a successful one.

    ``threshold`` failures within ``window`` open the circuit; while it is open
    calls are refused and count for nothing. After ``cooldown`` it is half open:
    the next call closes it, if it succeeds, or opens it again. Closing forgets
    failures; a success of a closed circuit doesn't.
    """

    columns = ["us", "was", "now", "failures", "refused"]

    def __init__(self, keys: list[str], threshold: int, window: int, cooldown: int) -> None:
        self.keys, self.threshold, self.window, self.cooldown = keys, threshold, window, cooldown

    def fresh(self) -> tuple:
        return ("CLOSED", 0, [], 0)

    def due(self, own: tuple) -> int | None:
        return own[1] + self.cooldown if own[0] == "OPEN" else None

    def wake(self, own: tuple, us: int, out: list[tuple]) -> tuple:
        state, opened, failures, refused = own
        if state == "OPEN" and us >= opened + self.cooldown:
            out.append((opened + self.cooldown, "OPEN", "HALF_OPEN", len(failures), refused))
            return ("HALF_OPEN", opened, failures, 0)
        return own

    def take(self, own: tuple, us: int, event_id: int, payload: str, out: list[tuple]) -> tuple:
        state, opened, failures, refused = own
        if state == "OPEN":
            return (state, opened, failures, refused + 1)
        failures = [f for f in failures if f > us - self.window]
        if payload != "bad":
            if state == "HALF_OPEN":
                out.append((us, "HALF_OPEN", "CLOSED", len(failures), 0))
                return self.fresh()
            return (state, opened, failures, refused)
        failures.append(us)
        if state == "HALF_OPEN" or len(failures) >= self.threshold:
            out.append((us, state, "OPEN", len(failures), 0))
            return ("OPEN", us, failures, 0)
        return (state, opened, failures, refused)


class Requests(InOrder):
    """The first request of a key reserves it for ``keep``; an equal payload then gets the stored request, another one is a conflict."""

    columns = ["us", "event_id", "outcome", "answered_by"]

    def __init__(self, keys: list[str], keep: int) -> None:
        self.keys, self.keep = keys, keep

    def fresh(self) -> tuple:
        return ("", -1, -1)

    def due(self, own: tuple) -> int | None:
        return own[2] if own[1] >= 0 else None

    def wake(self, own: tuple, us: int, out: list[tuple]) -> tuple:
        return self.fresh() if own[1] >= 0 and us >= own[2] else own

    def take(self, own: tuple, us: int, event_id: int, payload: str, out: list[tuple]) -> tuple:
        if own[1] < 0:
            out.append((us, event_id, "RESERVED", event_id))
            return (payload, event_id, us + self.keep)
        same = own[0] == payload
        out.append((us, event_id, "STORED" if same else "CONFLICT", own[1]))
        return own


def keyed(stream: DataFrame, processor: InOrder, payload: Column, out: str, delay: str, groups: int = GROUPS) -> DataFrame:
    """The processor's keys and what it gives (out) for a stream with ts and event_id; ``delay``: how much later than others a row may come."""
    ship_package(stream.sparkSession)
    keys = processor.keys
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    group, key = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("group"), F.to_json(F.struct(*keys)).alias("key")
    rows = stream.withWatermark("ts", delay).filter("ts is not null").select(group, key, "ts", "event_id", F.unix_micros("ts").alias("us"), payload.alias("payload"))
    found = rows.groupBy("group").transformWithStateInPandas(processor, f"key string, {out}", "append", "eventtime")
    return found.select(F.from_json("key", kinds).alias("key"), *processor.columns).select("key.*", *processor.columns)


def breaker_transitions(stream: DataFrame, keys: list[str], bad: Column, threshold: int, window_s: int, cooldown_s: int, delay: str) -> DataFrame:
    """keys, us, was, now, failures (in the window), refused (calls since it opened): each change of a circuit's state."""
    processor = Breaker(keys, threshold, window_s * SECOND, cooldown_s * SECOND)
    return keyed(stream, processor, F.when(bad, "bad").otherwise("good"), "us long, was string, now string, failures long, refused long", delay)


def idempotent_requests(stream: DataFrame, keys: list[str], payload: Column, keep_s: int, delay: str) -> DataFrame:
    """keys, us, event_id, outcome (RESERVED, STORED or CONFLICT), answered_by: the request that holds the key. payload is compared by its hash."""
    hashed = F.sha2(F.coalesce(payload.cast("string"), F.lit("")), 256)
    return keyed(stream, Requests(keys, keep_s * SECOND), hashed, "us long, event_id long, outcome string, answered_by long", delay)


def run_to_end(rows: DataFrame, name: str) -> DataFrame:
    """Runs the keyed stream over what is there, state in RocksDB under the checkpoint, and reads its result."""
    spark = rows.sparkSession
    place = shared_folder(spark, f"stream-{name}")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        started = rows.writeStream.option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{place}/rows").start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")
