"""Structured Streaming over event files: windows, deduplication, and a keyed circuit breaker.

A query runs over what is there (trigger availableNow), keeps its progress in a
checkpoint and writes to the shared folder, from which the result is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files as a stream; the schema is that of the files that are there. path is a folder or a pattern of files."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a streaming query over what is there; in complete mode the last state replaces the ones before."""
    spark = stream.sparkSession
    place = shared_folder(spark, f"stream-{name}")
    writer = stream.writeStream.option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{place}/rows")
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/rows"))
    started = writer.start()
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def tumbling_counts(stream: DataFrame, size: str) -> DataFrame:
    window = F.window("ts", size)
    counts = stream.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def distinct_requests(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


BREAKER_OUT = "user_id long, failures long, opened long"
BREAKER_STATE = "failures long, run long, opened long"


def breaker(threshold: int) -> Callable:
    """Counts consecutive failures of a key; ``threshold`` of them open the circuit, and a success closes it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, run, opened = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            if kind == "error":
                failures, run = failures + 1, run + 1
                opened += run == threshold
            else:
                run = 0
        state.update((failures, run, opened))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "opened": [int(opened)]})

    return step


def circuit_breaker(stream: DataFrame, threshold: int = 2) -> DataFrame:
    ship_package(stream.sparkSession)
    keyed = stream.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(breaker(threshold), BREAKER_OUT, BREAKER_STATE, "update", "NoTimeout")
