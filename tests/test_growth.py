"""What queries shuffle or take as their tables grow."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factweave.operators import temporal
from factweave.plans import registry

registry.load()


def shuffled(spark, name, sf_dir):
    """The rows of a query, and how many bytes its run shuffled."""
    def total():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = total()
    rows = registry.QUERIES[name](spark, sf_dir).collect()
    return rows, total() - before


def test_question_anchors_meet_by_class(spark, tmp_path):
    n = 40_000
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-01").cast("date").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    sizes = []
    for i, questions in enumerate((1_000, 20_000)):
        place = f"{tmp_path}/{i}"
        spark.range(questions).select(F.col("id").alias("s_suppkey")).write.parquet(f"{place}/supplier.parquet")
        spark.read.parquet(f"{tmp_path}/orders.parquet").write.parquet(f"{place}/orders.parquet")
        rows, size = shuffled(spark, "question_anchors", place)
        assert len(rows) == questions // 20 * 3
        sizes.append(size)
    assert sizes[1] < 1.5 * sizes[0]


def test_window_co_occurrence_sums_pairs_before_they_shuffle(spark, tmp_path):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}longword" for i in range(60)]
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit(" ".join(words)).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows, size = shuffled(spark, "window_co_occurrence", str(tmp_path))
    assert len(rows) == sum(min(30, 59 - i) for i in range(60))
    assert all(r.docs == r.times == 400 for r in rows)
    assert size < 1_000_000  # a few rows a pair and task, not one for each document's pair


def test_claim_chunk_bridge_on_a_long_document(spark, tmp_path):
    said = [f"This is the sentence with number {i:05d} of a long document." for i in range(6_000)]
    spark.createDataFrame([(1, " ".join(said))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.time()
    rows = {r.pos: r.chunk for r in registry.QUERIES["claim_chunk_bridge"](spark, str(tmp_path)).collect()}
    assert time.time() - start < 30
    size = len(said[0])
    first = lambda at: next(c for c in range(400) if c * 1300 <= at and at + size <= c * 1300 + 1500)
    assert rows == {i: first(i * (size + 1)) for i in range(6_000)}


def test_verbatim_spans_counts_quotes_that_do_not_overlap(spark, tmp_path):
    texts = [(5, "aXa-aXa-aXa. Once only here. aXa-aXa-aXa. end of it all. and end of it all. "), (10, "ab ab ab ab ab ab. ab ab ab ab. No more.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by = dict(texts)
    for r in registry.QUERIES["verbatim_spans"](spark, str(tmp_path)).collect():
        said = [m.strip() for m in re.findall(r"[^.!?\n]+[.!?]?", by[r.doc_id])][r.pos]
        n = by[r.doc_id].count(said)
        assert (r.status, r.char_start, r.quality) == ("exact", by[r.doc_id].index(said), "unique" if n == 1 else "ambiguous")


@pytest.mark.parametrize("few", [0, 3, 256])
def test_overlapping_by_key_and_by_tree(spark, few):
    rnd = random.Random(few)
    side = lambda n: [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(40)]), rnd.choice([None, *range(60)])) for i in range(n)]
    left, right = side(60), side(50)
    frames = [spark.createDataFrame(x, "id long, k long, s long, e long") for x in (left, right)]
    got = sorted((r.left.id, r.right.id) for r in temporal.overlapping(*frames, ["k"], "s", "e", 16, few).collect())
    begin, until = lambda x: x[2] or 0, lambda x: 1 << 16 if x[3] is None else x[3]
    holds = lambda x: begin(x) < until(x)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and holds(x) and holds(y) and begin(x) < until(y) and begin(y) < until(x))
    assert got == want


def test_overlapping_offers_shuffles_a_line_once(spark, tmp_path):
    rows = [(i, 1, i % 200, i % 7, i % 11 / 100, "N" if i % 2 else "R", float(i % 50 + 1)) for i in range(8_000)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_discount double, l_returnflag string, l_quantity double")
    lines.withColumn("l_shipdate", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("l_orderkey") % 900).cast("int"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, "overlapping_offers", str(tmp_path))[1] < 1_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
