"""Plans and rounds: plans don't grow from round to round, rounds move much, and rows are parsed once."""

import random

from factweave.operators import graph, holes, louvain, values
from factweave.plans import registry
from pyspark.sql import functions as F

registry.load()
SF = "/root/testdata/sf0.001"


def test_components_keep_no_constraints_of_earlier_rounds(spark):
    nodes = list(range(200))
    random.Random(4).shuffle(nodes)
    chain = spark.createDataFrame(list(zip(nodes, nodes[1:])), "src long, dst long")
    found = graph.components(chain)
    assert sorted(map(tuple, found.collect())) == [(n, 0) for n in range(200)]
    # a checkpoint kept them, and they doubled until the driver had no memory left
    assert found._jdf.queryExecution().optimizedPlan().constraints().size() <= 10


def test_many_nodes_of_a_clique_move_in_a_louvain_round(spark):
    clique = [(a, b, 1.0) for a in range(40) for b in range(a + 1, 40)]
    both = louvain.both_ways(spark.createDataFrame(clique, "src long, dst long, weight double"))
    state = both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("community"), "k", F.lit(0.0).alias("loop"))
    found, _ = louvain.local_moving(both, state, 2)
    assert found.filter("node != community").count() >= 10  # of a neighbourhood one node moved


def test_common_neighbours_by_blocks_as_plain(spark, monkeypatch):
    rng = random.Random(8)
    near = {n: {} for n in range(90)}
    for a in range(90):
        for b in range(a):
            if a == 0 or b == 0 or rng.random() < (0.3 if a % 9 == b % 9 else 0.08):  # node 0 is a hub
                near[a][b], near[b][a] = rng.random() + 0.1, rng.random() + 0.1
    want = {}
    for i in near:
        for j in near[i]:
            common = near[i].keys() & near[j].keys()
            if common:
                want[i, j] = (round(sum(near[i][q] * near[q][j] for q in common), 9), len(common))
    share = spark.createDataFrame([(i, j, p) for i in near for j, p in near[i].items()], "i long, j long, p double").repartition(3)
    for links in (40, 1 << 19):
        monkeypatch.setattr(holes, "LINKS", links)
        got = holes.through_common(share).collect()
        assert len(got) == len(want) and {(r.i, r.j): (round(r.more, 9), r.common) for r in got} == want


def patterns(df):
    """How often the executed plan names the first pattern that a kind is told by."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("at most|no more than")


def test_the_kind_is_told_once(spark):
    own = spark.createDataFrame([("at most 3,5 kg",), ("7 mm",), ("one of 1, 2",), (None,)], "t string").select(values.parse(F.col("t")).alias("v"))
    assert [(r.kind, r.low, r.high, r.unit) if r.kind else None for r in own.select("v.*").collect()] == [
        ("at_most", None, 3.5, "kg"), ("scalar", 7.0, 7.0, "mm"), ("set", None, None, None), None]
    assert patterns(own.groupBy("v.kind").agg(F.max("v.high"), F.max("v.low"), F.max("v.unit"))) <= 2  # to tell the kind, and to read the number


def test_statements_are_parsed_once(spark):
    for name in ("typed_comparison", "value_contradiction_filter", "verdict_aggregation", "answer_level_checks"):
        assert patterns(registry.QUERIES[name](spark, SF)) <= 2, name
