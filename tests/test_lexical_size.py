"""Word counts without a shuffle, what searches and evidence take, and graphs that are worked out once."""

import collections
import random

from pyspark.sql import functions as F

from factweave.operators import lexical
from factweave.plans import registry
from factweave.plans.graph import strong

from test_growth import shuffled

registry.load()


def test_counts_of_lists(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice("abcdé") for _ in range(rnd.randrange(30))]) for i in range(30)] + [(99, None)]
    got = sorted(map(tuple, lexical.counts_of_lists(spark.createDataFrame(rows, "doc_id long, w array<string>"), "doc_id", "w").collect()))
    assert got == sorted((i, len(w), t, n) for i, w in rows if w for t, n in collections.Counter(w).items())


def test_tfidf_salience_shuffles_no_counts_twice(spark, tmp_path):
    rows = [(i, " ".join(f"t{(i * 7 + j) % 5000}" for j in range(200))) for i in range(2_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found, size = shuffled(spark, "tfidf_salience", str(tmp_path))
    assert len(found) == 10_000
    assert size < 2_000_000


def test_evidence_modes_orders_once_and_takes_nulls_last(spark, tmp_path):
    orders = [(1, "1-URGENT"), (2, "2-HIGH"), (3, "3-MEDIUM"), (4, "4-LOW")]
    lines = [(o, p, s, q, d) for o in range(1, 5) for p, s, q, d in [(10, 1, 5.0, None), (20, 2, 7.0, "1995-01-03"), (30, 4, 9.0, "1995-01-02"), (40, 3, None, "1995-01-01"), (None, 2, 7.0, "1995-01-03")]]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    frame = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string")
    frame.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["evidence_modes"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, "single", 1, 30), (2, "exhaustive", 5, 100), (3, "comparative", 3, 90), (4, "chronological", 2, 70)]


def test_combined_centrality_makes_its_edges_once(spark, monkeypatch):
    monkeypatch.setitem(registry.QUERIES, "strong", lambda spark, sf_dir: strong(spark, sf_dir))
    rows, once = shuffled(spark, "strong", "/root/testdata/sf0.01")
    assert len(shuffled(spark, "combined_centrality", "/root/testdata/sf0.01")[0]) == 100
    assert shuffled(spark, "combined_centrality", "/root/testdata/sf0.01")[1] < 3 * once
