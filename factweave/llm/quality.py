"""Quality selection by importance resampling over hashed n-gram models.

Two generative models give each hashed n-gram a probability: one of the target
text (documents labelled good), one of all raw text. A document's log weight is
the sum over its n-grams of the log ratio of the two; adding Gumbel noise to
the log weights and taking the largest k samples without replacement in
proportion to the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .langid import held_out
from .mixing import uniform

BUCKETS = 1 << 14
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")
#: Added to each bucket's count, so that no probability is zero.
SMOOTHING = 1.0


def gram_buckets(text: str | None) -> np.ndarray:
    """The buckets of the text's words and word pairs, repeats included; letters and other signs are words of their own."""
    words = TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate((one * np.uint64(0x9E3779B97F4A7C15), two)) >> np.uint64(50)).astype(np.int64) % BUCKETS


def _model_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
            counts = np.bincount(gram_buckets(text.as_py()), minlength=BUCKETS)
            raw += counts
            if good:
                target += counts
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, good: DataFrame, id_col: str, text_col: str, sample: int) -> np.ndarray:
    """log target / raw for each bucket. The raw model counts every row of docs; the target's about ``sample`` rows of good.

    The sample's ids are written, so that Spark broadcasts them by their size; what comes to the driver is one row for each bucket.
    """
    n = good.count()
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < min(1.0, sample / max(n, 1)) * (1 << 40)
    chosen = materialize(good.filter(near).select(F.col("doc_id").alias("id")).distinct(), "target-ids")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = own.join(chosen, own["doc_id"] == chosen["id"], "left").select("text", F.col("id").isNotNull().alias("good"))
    counts = rows.mapInArrow(_model_batches, "bucket long, raw long, target long")
    totals = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in totals:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == SMOOTHING * BUCKETS:  # nothing is labelled good: all documents weigh the same
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


#: Ranges in which the cut is looked for at a time.
PARTS = 1024


def _cut(rows: DataFrame, bounds: DataFrame, part, k: int):
    """The value in column v at which the k largest rows end, and how many of its rows they take.

    Each round counts the rows of PARTS ranges (with a map side) and goes on in
    the range where the k-th row is, until that holds one value. What comes to
    the driver is one row for each range.
    """
    low, high = bounds.first()
    while True:
        counted = rows.filter(F.col("v").between(low, high)).groupBy(part(low, high).alias("part"))
        found = counted.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["part"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low, k


def largest(scored: DataFrame, share: float) -> DataFrame:
    """Adds kept: true for the round(share * rows) rows with the largest key, then the largest doc_id, null last.

    The cut is found by counting ranges, first of keys, then of the ids that
    have the cut's key. Rows equal in both are as good as each other: they are
    counted by partition, and each partition keeps a number of its own.
    """
    n = scored.count()
    k = round(share * n)
    if k == 0 or k == n:
        return scored.withColumn("kept", F.lit(k > 0))
    keys = scored.select(F.col("key").alias("v"))
    width = lambda low, high: F.least(F.lit(PARTS - 1), F.floor((F.col("v") - low) / (high - low) * PARTS)) if high > low else F.lit(0)
    key, k = _cut(keys, keys.agg(F.min("v"), F.max("v")), width, k)
    tied = scored.filter(F.col("key") == key)
    named, ids = tied.filter("doc_id is not null").count(), tied.select(F.col("doc_id").alias("v")).filter("v is not null")
    own = None
    if k <= named:
        exact = lambda low, high: F.expr(f"cast((cast(v as decimal(20,0)) - {low}) * {PARTS} div ({high - low + 1}) as int)")
        own, k = _cut(ids, ids.agg(F.min("v"), F.max("v")), exact, k)
        above = tied.filter(F.col("doc_id") > own)
        below = tied.filter(F.col("doc_id").isNull() | (F.col("doc_id") < own))
        last = tied.filter(F.col("doc_id") == own)
    else:
        k -= named
        above, below, last = tied.filter("doc_id is not null"), tied.limit(0), tied.filter("doc_id is null")
    parts = [scored.filter(F.col("key") != key).withColumn("kept", F.col("key") > key), above.withColumn("kept", F.lit(True)), below.withColumn("kept", F.lit(False))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.unionByName(_some(last, k))


def _some(rows: DataFrame, k: int) -> DataFrame:
    """kept is true for k of the rows: of equal rows, any. The window runs over one row for each partition and kind of row."""
    order = Window.orderBy("part", *rows.columns).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("part", F.spark_partition_id()).groupBy("part", *rows.columns).agg(F.count("*").alias("n"))
    counted = counted.withColumn("times", F.lit(k) - (F.sum("n").over(order) - F.col("n")))
    return counted.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*rows.columns, (F.col("i") <= F.col("times")).alias("kept"))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float | None = None,
    sample: int = 20_000,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, score, key, kept.

    labels: doc_id and quality, above 0 for good; those of held-out ids (crc32
    of the id, in fifths) are not used. score is the mean log ratio of the
    document's n-grams. share: of the rows to keep; by default the share of good
    ones among the labels, or all rows if there are no labels. Null and empty
    texts have no n-grams and log weight 0. Repeated rows have equal weights
    and noise; a null id has noise of its own. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    if share is None:
        share = known.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    ratios = log_ratios(docs, known.filter("quality > 0").select("doc_id"), id_col, text_col, sample)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = [], []
            for text in batch.column(1):
                found = gram_buckets(text.as_py())
                n.append(found.size)
                total.append(float(ratios[found].sum()))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_grams", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(weigh, "doc_id long, n_grams long, log_weight double")
    gumbel = -F.log(-F.log(uniform(F.lit(seed), F.lit("gumbel"), F.col("doc_id"))))
    mean = F.col("log_weight") / F.greatest("n_grams", F.lit(1))
    scored = scored.withColumn("score", mean).withColumn("key", F.col("log_weight") + gumbel)
    return largest(materialize(scored, "quality-weights"), share)


def op3_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
