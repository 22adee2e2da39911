"""Cascades of closings, and concepts that grow by batches, against plain versions."""

import random

from pyspark.sql import functions as F

from factweave.operators import holes, temporal
from factweave.operators.resolver import ConceptStore


def test_cascade_as_plain(spark):
    rng = random.Random(6)
    nodes = {i: rng.randrange(100, 200) if rng.random() < 0.3 else None for i in range(80)}
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(110)] + [(3, 3), (900, 4)]
    best = {i: (c, i) if c is not None else None for i, c in nodes.items()}
    moving = True
    while moving:
        moving = False
        for a, b in edges:
            if best.get(a) and (best[b] is None or best[a] < best[b]):
                best[b], moving = best[a], True
    df = spark.createDataFrame([*nodes.items(), (5, None)], "id long, closes long")
    got = temporal.cascade(df, spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: (r.closes, r.cause) if r.closes is not None else None for r in got} == best and len(got) == 80
    assert all((r.moved_in > 0) == (best[r.id] != ((nodes[r.id], r.id) if nodes[r.id] is not None else None)) for r in got)
    assert temporal.cascade(df.limit(0), spark.createDataFrame(edges, "src long, dst long")).count() == 0


def test_both_times_are_kept(spark):
    before = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, closes long")
    after = spark.createDataFrame([(1, 5), (2, 6), (3, 6)], "id long, closes long")
    rows = temporal.bitemporal(before, after, ["id"], "closes", F.lit(1), F.lit(2)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 5, 1, None), (2, None, 1, 2), (3, 7, 1, 2), (2, 6, 2, None), (3, 6, 2, None)], key=str)


def test_batches_give_the_clusters_of_the_whole(spark):
    rng = random.Random(9)
    rows = [(i, f"k{rng.randrange(70)}") for i in range(60) for _ in range(rng.randrange(1, 3))]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by: dict[str, int] = {}
    for i, k in rows:
        a, b = sorted((root(i), root(by.setdefault(k, i))))
        parent[b] = a
    want = {i: root(i) for i, _ in rows}
    df = spark.createDataFrame([*rows, (None, "k1"), (70, None)], "item long, key string")
    store = ConceptStore(spark)
    merges = 0
    for n in (2, 0, 1):
        merges += store.insert(df.filter(F.col("item") % 3 == n)).count()
    assert merges > 0
    keys = len({k for _, k in rows})
    assert store.changes[-1] < keys  # a batch writes what it changes, not the whole
    assert {r.item: r.cluster for r in store.resolve(df).collect()} == want
    store.compact()
    assert store.version == 1 and store.known().count() == keys
    again = store.insert(df.filter("item = 5"))
    assert again.count() == 0 and store.changes[-1] == 0
    assert {r.item: r.cluster for r in store.resolve(df).collect()} == want


def test_holes(spark):
    """Two triangles that one node joins: it is the least constrained; a node with one neighbour is constrained by that alone."""
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (6, 1), (6, 6)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    assert sorted(tuple(sorted(r)) for r in holes.triangles(holes.undirected(df)).collect()) == [(1, 2, 3), (3, 4, 5)]
    got = {r.node: r for r in holes.structural_holes(df).collect()}
    assert min(got, key=lambda n: got[n].constraint) == 3 and got[3].triangles == 2
    assert got[6].constraint == 1.0 and got[6].clustering == 0.0
    assert abs(got[2].constraint - ((0.5 + 0.5 / 4) ** 2 + (0.5 + 0.5 / 3) ** 2)) < 1e-9


def test_overlapping_validities_as_plain(spark):
    rng = random.Random(12)

    def some(n):
        out = []
        for i in range(n):
            s = rng.randrange(0, 200)
            out.append((i, rng.choice("ab") if rng.random() < 0.95 else None, s if rng.random() < 0.9 else None, s + rng.choice([0, 1, 3, 40, 150]) if rng.random() < 0.85 else None))
        return out

    left, right = some(70), some(60)
    schema = "id long, k string, s long, e long"
    got = temporal.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "s", "e", 10).collect()
    want = []
    for i, k, s, e in left:
        for j, m, t, u in right:
            a, b, c, d = s or 0, 1024 if e is None else e, t or 0, 1024 if u is None else u
            if k is not None and k == m and a < b and c < d and a < d and c < b:
                want.append((i, j))
    assert sorted((r.left.id, r.right.id) for r in got) == sorted(want) and len(want) > 500


def test_tree_nodes_make_up_the_interval(spark):
    for s, e in ((0, 1), (3, 17), (5, 5), (0, 1024), (1023, 1024), (1, 1023)):
        nodes = spark.range(1).select(temporal.tree_nodes(F.lit(s).cast("long"), F.lit(e).cast("long"), 10).alias("n")).first().n
        assert sorted(t for n in nodes for t in range(n.place << n.level, (n.place + 1) << n.level)) == list(range(s, e))
