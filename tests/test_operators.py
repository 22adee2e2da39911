"""Operators on small rows: ties, nulls, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factweave.functions.strings import jaro_winkler
from factweave.operators import graph, lexical, temporal, vectors
from factweave.operators.rules import Condition, Rule, first_match
from factweave.sources.tables import UnscopedQuery, for_tenant

DAY = lambda d: dt.datetime(2024, 1, d)


def test_tenant_guard(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int")
    assert for_tenant(df, "a").count() == 1
    assert for_tenant(df, None, bypass_reason="report over all tenants").count() == 2
    with pytest.raises(UnscopedQuery):
        for_tenant(df, "")


def test_valid_at_bounds(spark):
    rows = [(1, DAY(1), DAY(5)), (2, DAY(5), None), (3, None, None), (4, DAY(6), DAY(9))]
    df = spark.createDataFrame(rows, "id int, valid_from timestamp_ntz, valid_until timestamp_ntz")
    at = F.lit("2024-01-05").cast("timestamp_ntz")
    assert sorted(r.id for r in temporal.valid_at(df, at).collect()) == [2, 3]
    assert sorted(r.id for r in temporal.valid_at(df, at, end_inclusive=True).collect()) == [1, 2, 3]


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "u", DAY(3)), (2, "u", DAY(1)), (3, "v", DAY(9)), (4, "u", DAY(5))], "id long, k string, t timestamp_ntz")
    right = spark.createDataFrame([(10, "u", DAY(2)), (11, "u", DAY(3)), (12, "u", DAY(3)), (13, "w", DAY(1))], "rid long, k string, t timestamp_ntz")
    got = {r.id: r.asof_rid for r in temporal.asof_join(left, right, ["k"], "t", "t", "rid", ["rid"]).collect()}
    assert got == {1: 12, 2: None, 3: None, 4: 12}


def test_rules():
    with pytest.raises(ValueError):
        Condition("a", "sounds_like", "b").column()


def test_rule_operators(spark):
    df = spark.createDataFrame([(1, "Alpha", "12", None), (2, None, "x", "y")], "id int, name string, n string, other string")
    cases = [("name", "equals", "ALPHA", [1]), ("name", "not_equals", "alpha", []), ("name", "contains", "LPH", [1]), ("name", "not_contains", "z", [1]), ("name", "starts_with", "al", [1]),
             ("name", "ends_with", "HA", [1]), ("name", "matches", "^A", [1]), ("name", "in", ["alpha", "b"], [1]), ("n", "greater_than", 3, [1]), ("n", "less_than", 3, []), ("other", "exists", None, [2]), ("other", "not_exists", None, [1])]
    for field, operator, value, want in cases:
        assert [r.id for r in df.filter(Condition(field, operator, value).column()).collect()] == want, operator
    rules = [Rule("low", 1, [Condition("name", "exists")], "A"), Rule("high", 9, [Condition("n", "equals", "12")], "B")]
    action, name = first_match(rules, default="D")
    assert [(r.a, r.b) for r in df.select(action.alias("a"), name.alias("b")).collect()] == [("B", "high"), ("D", "-")]


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 0.5)], "src long, dst long, weight double")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in graph.reach(edges, start, 3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 1.0)], "src long, dst long, weight double")
    ranks = {r.node: r.rank for r in graph.pagerank(edges, 8).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks[3] > ranks[2] > ranks[1]


def test_rank_fusion(spark):
    one = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    two = spark.createDataFrame([(2, 0)], "id long, rank int")
    got = {r.id: r.rrf for r in lexical.reciprocal_rank_fusion([one, two], "id", 5).collect()}
    assert got == {1: pytest.approx(1 / 60 + 1 / 76), 2: pytest.approx(1 / 61 + 1 / 60)}


def test_co_occurrence_leaves_hubs_out(spark):
    rows = [(g, i) for g in range(4) for i in ("hub", f"a{g % 2}", "b")]
    items = spark.createDataFrame(rows, "g int, item string")
    got = {(r.a, r.b): r.groups for r in lexical.co_occurrence(items, "g", "item", most_common=3).collect()}
    assert got == {}
    got = {(r.a, r.b): r.groups for r in lexical.co_occurrence(items, "g", "item").collect()}
    assert got[("b", "hub")] == 4 and got[("a0", "b")] == 2


def test_top_k_against_all(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [(90, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.filter("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    got = {(r.query_id, r["rank"]): r.id for r in vectors.top_k(df, asked, "id", "v", 3, blocks=2).collect()}

    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0

    for q, v in rows:
        if q % 30 == 0:
            order = sorted((-cosine(v, w), i) for i, w in rows if i != q)
            assert [got[q, k + 1] for k in range(3)] == [i for _, i in order[:3]]


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("", "a", 0.0), ("same", "same", 1.0), ("ab", "cd", 0.0)])
def test_jaro_winkler(a, b, want):
    assert jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)
