"""The vector index, the joins and clusters on it, against plain versions over all pairs."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import index as I
from factweave.operators import linkage
from factweave.operators import vectors as V
from factweave.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


def clustered(n=240, groups=8, width=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, width))
    rows = [(i, (centers[i % groups] + 0.35 * rng.normal(size=width)).tolist(), f"t{i % 5}") for i in range(n)]
    rows += [(1000, [0.0] * width, "t0"), (1001, list(rows[3][1]), "t1"), (1002, list(rows[3][1]), None), (1003, None, "t0"), (1004, [1.0, None], "t0"), (1005, [1.0, 2.0], "t2")]
    return rows


def good(rows):
    width = max(len(v) for _, v, _ in rows if v)
    own = [(i, [*v, *[0.0] * (width - len(v))], t) for i, v, t in rows if v is not None and None not in v]
    m = np.array([v for _, v, _ in own])
    size = np.linalg.norm(m, axis=1)
    m = m / np.where(size > 0, size, 1)[:, None]
    return own, np.round(m @ m.T, 6)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(clustered(), "id long, embedding array<double>, tag string").repartition(3)


@pytest.fixture(scope="module")
def index(table):
    return I.build(table, "id", "embedding", "tag")


def test_every_row_is_in_one_cell(index):
    assert index.rows.count() == index.rows.select("id").distinct().count() == len(good(clustered())[0])


@pytest.mark.parametrize("rule,least", [("", None), ("across", None), ("within", 0.2)])
def test_all_cells_give_exact_neighbours(index, rule, least):
    own, similar = good(clustered())
    want = []
    for x, (i, _, t) in enumerate(own):
        ok = [y for y, (j, _, u) in enumerate(own) if j != i and (rule != "across" or t != u) and (rule != "within" or t == u) and (least is None or similar[x, y] >= least)]
        want += [(i, own[y][0], round(similar[x, y] + 0.0, 6), r) for r, y in enumerate(sorted(ok, key=lambda y: (-similar[x, y], own[y][0]))[:4], 1)]
    got = I.search(index, index.rows.select("id", "v", "tag"), 4, 10**6, rule, least)
    assert sorted((r.query_id, r.id, round(r.similarity, 6), r["rank"]) for r in got.collect()) == sorted(want)


def test_recall_is_reached_with_few_visits(index):
    asked = index.rows.select("id", "v", "tag").filter("id % 5 = 0")
    chosen = I.choose_visits(index, asked, 5, 0.9)
    exact = I.search(index, asked, 5, 10**6)
    found = I.search(chosen, asked, 5, chosen.visits)
    assert chosen.visits < len(index.centroids)
    assert found.join(exact, ["query_id", "id"], "left_semi").count() >= 0.9 * exact.count()


def test_recall_on_the_given_vectors(spark):
    got = registry.QUERIES["indexed_top_k"](spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = V.top_k(rows, asked, "vec_id", "embedding", 10)
    assert got.count() == exact.count()
    assert got.join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").count() >= 0.9 * exact.count()


@pytest.mark.parametrize("least", [0.3, 0.8, 0.99])
def test_join_loses_no_pair(index, least):
    own, similar = good(clustered())
    want = sorted((a, b, round(similar[x, y], 6)) for x, (a, _, _) in enumerate(own) for y, (b, _, _) in enumerate(own) if a < b and similar[x, y] >= least)
    got = sorted((r.a, r.b, round(r.similarity, 6)) for r in I.pairs_over(index, least).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]


def plain_linkage(ids, similar, least):
    clusters = {i: [k] for k, i in enumerate(ids)}
    while True:
        pairs = [(-min(similar[x, y] for x in clusters[a] for y in clusters[b]), a, b) for a in clusters for b in clusters if a < b]
        s, a, b = min(pairs, default=(0, 0, 0))
        if -s < least:
            return {ids[k]: c for c, members in clusters.items() for k in members}
        clusters[a] += clusters.pop(b)


def test_complete_linkage_as_plain(spark):
    rows = clustered(n=60)[:63]
    own, similar = good(rows)
    table = spark.createDataFrame(rows, "id long, embedding array<double>, tag string").repartition(3)
    got = {r.id: r.cluster for r in linkage.linkage_clusters(table, "id", "embedding", 0.55).collect()}
    assert got == plain_linkage([i for i, _, _ in own], similar, 0.55)
    members = defaultdict(list)
    for k, (i, _, _) in enumerate(own):
        members[got[i]].append(k)
    assert len(members) > 5 and all(similar[x, y] >= 0.55 for m in members.values() for x in m for y in m if x < y)


def test_complete_linkage_by_levels_as_plain(spark, monkeypatch):
    rows = clustered(n=120)[:123]
    own, similar = good(rows)
    table = spark.createDataFrame(rows, "id long, embedding array<double>, tag string").repartition(3)
    seen, whole = [], linkage.complete_linkage

    def counted(links, *rest):
        seen.append(links.count())
        return whole(links, *rest)

    monkeypatch.setattr(linkage, "complete_linkage", counted)
    got = {r.id: r.cluster for r in linkage.linkage_clusters(table, "id", "embedding", 0.3, links=2, few=40, size=16, group=2).collect()}
    assert got == plain_linkage([i for i, _, _ in own], similar, 0.3)
    # The rows themselves have far more links than any level takes.
    assert len(seen) > 2 and 4 * max(seen) < (np.triu(similar, 1) >= 0.3).sum()


def test_nothing_in_nothing_out(spark, table):
    none = table.limit(0)
    assert linkage.linkage_clusters(none, "id", "embedding", 0.5).count() == 0
    empty = I.build(none, "id", "embedding")
    assert I.search(empty, empty.rows.select("id", "v", "tag"), 3, 2).count() == I.pairs_over(empty, 0.5).count() == 0
