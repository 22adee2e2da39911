"""Pairs and searches by matrix products of lists, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import blocks as B
from factweave.operators import index as I
from factweave.operators import vectors as V
from factweave.plans import registry

from test_growth import shuffled

registry.load()


def some_vectors(n, width=8, seed=3):
    rnd = random.Random(seed)
    rows = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(n)]
    rows[5], rows[6] = rows[2], [0.0] * width  # a copy, and no direction
    return rows


def cosine(x, y):
    size = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
    return round(sum(a * b for a, b in zip(x, y)) / size, 6) if size else 0.0


@pytest.mark.parametrize("size", [4, 512])
def test_signal_pairs_equal_all_pairs(spark, size):
    rnd = random.Random(size)
    rows = [(i, v, rnd.choice([None, 1, 2]), rnd.choice([None, "x", "y"]), rnd.choice("abcde"), rnd.choice([0.0, 0.25])) for i, v in enumerate(some_vectors(60))]
    rows = [(*r[:5], 0.25 if r[4] in "ab" else 0.0) for r in rows]
    frame = spark.createDataFrame(rows, "id long, v array<double>, label int, facet string, key string, base double")
    found = B.signal_pairs(frame, {"label": 0.2, "facet": 0.15}, 0.3, 0.4, size)
    got = {(r.a, r.b): round(0.3 * r.similarity + r.base + r.label + r.facet, 6) for r in found.collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[4] == y[4]:
                same = sum(w for c, w in ((2, 0.2), (3, 0.15)) if x[c] is not None and x[c] == y[c])
                want[x[0], y[0]] = round(0.3 * cosine(x[1], y[1]) + x[5] + same, 6)
    assert {k: s for k, s in got.items() if s >= 0.4} == {k: s for k, s in want.items() if s >= 0.4}


def test_multi_signal_pairs_sends_no_pair_of_vectors(spark, tmp_path):
    n = 600
    vectors = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(some_vectors(n, 64))], "vec_id long, embedding array<double>, label int")
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).select(F.col("id").alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, size = shuffled(spark, "multi_signal_pairs", str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) > n
    assert size < 5_000_000  # 180,000 pairs share the part


@pytest.mark.parametrize("flat", [True, False])
@pytest.mark.parametrize("size", [7, 8192])
def test_pairs_over_lists_and_cells(spark, monkeypatch, flat, size):
    monkeypatch.setattr(B, "LIST", size)
    monkeypatch.setattr(B.pairs_of_all, "__defaults__", (size,))
    own = some_vectors(50)
    index = I.build(spark.createDataFrame(list(enumerate(own)), "id long, v array<double>"), "id", "v")
    got = sorted((r.a, r.b, round(r.similarity, 6)) for r in I.pairs_over(index, 0.4, flat).collect())
    assert got == [(i, j, s) for i in range(50) for j in range(i + 1, 50) if (s := cosine(own[i], own[j])) >= 0.4]


def test_pairs_of_vectors_without_structure_are_not_sent_to_cells(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(some_vectors(1_500, 64))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    _, size = shuffled(spark, "similarity_join", str(tmp_path))
    assert size < 5_000_000  # nearly every row may have a near one in every cell


@pytest.mark.parametrize("rule", ["", "within", "across"])
@pytest.mark.parametrize("size", [9, 8192])
def test_nearest_equal_all_pairs(spark, rule, size):
    own = [(i, v, None if i % 5 == 0 else "xy"[i % 2]) for i, v in enumerate(some_vectors(60) )]
    own[20] = (20, own[40][1], own[20][2])  # a tie for every query
    rows = spark.createDataFrame(own, "id long, v array<double>, tag string")
    best = {}
    for r in B.nearest(rows, rows.filter("id % 3 = 0"), 4, rule, size).collect():
        best.setdefault(r.query_id, []).append((-r.similarity, r.id))
    for q in range(0, 60, 3):
        fits = lambda t: not rule or (t == own[q][2]) == (rule == "within")  # noqa: B023, E731
        want = sorted((-cosine(own[q][1], v), i) for i, v, t in own if i != q and fits(t))[:4]
        assert [i for _, i in sorted(best[q])[:4]] == [i for _, i in want]


def test_top_k_leaves_out_rows_without_a_vector(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [None, 1.0])], "id long, v array<double>")
    got = V.top_k(rows, rows.select(F.col("id").alias("query_id"), F.col("v").alias("query")), "id", "v", 2).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(0, 1), (1, 0)]
