"""Density clusters against a plain version that works from the top down on all pairs of rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import density as D


def points(seed, apart=6.0, loose=12):
    rng = np.random.default_rng(seed)
    groups = [rng.normal(loc=c, scale=s, size=(n, 2)) for c, s, n in (((0, 0), 0.5, 25), ((apart, 0), 0.4, 18), ((apart, 3), 0.3, 14), ((0, apart), 1.0, 22))]
    return np.concatenate([*groups, rng.uniform(-3, apart + 3, size=(loose, 2))])


def distances(p):
    return np.round(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)), 6)


def reach(p, core, k):
    """Edges over each row's k nearest others."""
    d, edges = distances(p), {}
    near = {i: sorted((d[i, j], j) for j in range(len(p)) if j != i)[:k] for i in range(len(p))}
    cores = {i: near[i][min(core, k) - 1][0] for i in near}
    for i, some in near.items():
        for x, j in some:
            edges[min(i, j), max(i, j)] = max(x, cores[i], cores[j])
    return near, edges


def forest_of(edges):
    root, out = {}, []

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for d, a, b in sorted((d, a, b) for (a, b), d in edges.items()):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((d, a, b))
    return out


def plain(edges, n, least):
    """From the whole down: the longest edge goes; a part with fewer than ``least`` rows leaves its cluster; of two larger parts each is a new one."""

    def parts(nodes, forest):
        by = defaultdict(set)
        for _, a, b in forest:
            by[a].add(b), by[b].add(a)
        seen, out = set(), []
        for s in sorted(nodes):
            if s not in seen:
                stack, own = [s], set()
                while stack:
                    i = stack.pop()
                    if i not in own:
                        own.add(i)
                        stack += by[i]
                seen |= own
                out.append((own, [e for e in forest if e[1] in own]))
        return out

    def inverse(d):
        return min(D.DENSEST, 1 / d) if d > 0 else D.DENSEST

    def best(nodes, forest, birth, whole):
        """Stability of the best choice within a cluster, and that choice."""
        own, now, left, stability = set(nodes), nodes, sorted(forest), 0.0
        while left:
            edge = left[-1]
            halves = parts(now, left[:-1])
            density = inverse(edge[0])
            large = [h for h in halves if len(h[0]) >= least]
            if len(large) == 2:
                stability += len(now) * (density - birth)
                below = [best(h, sorted(f), density, False) for h, f in large]
                total = sum(b[0] for b in below)
                if whole or total > stability:
                    return total, below[0][1] + below[1][1]
                return stability, [own]
            if not large:
                stability += len(now) * (density - birth)
                break
            stability += (len(now) - len(large[0][0])) * (density - birth)
            now, left = large[0][0], sorted(large[0][1])
        return stability, [] if whole else [own]

    tops = [p for p in parts(range(n), forest_of(edges)) if len(p[0]) >= least]
    return sorted(sorted(c) for nodes, forest in tops for c in best(nodes, sorted(forest), 0.0, len(tops) == 1)[1])


@pytest.mark.parametrize("seed,k,run", [(1, 1000, 1 << 19), (2, 6, 30)])
def test_clusters_as_plain(spark, monkeypatch, seed, k, run):
    monkeypatch.setattr(D, "EDGES_AT_ONCE", run)
    p = points(seed)
    near, edges = reach(p, 5, min(k, len(p) - 1))
    rows = [(i, j, x, r) for i, some in near.items() for r, (x, j) in enumerate(some, 1)]
    df = spark.createDataFrame([(i, j, float(x), r) for i, j, x, r in rows], "query_id long, id long, distance double, rank long")
    made = D.mutual_reachability(df, 5)
    assert {(r.a, r.b): r.d for r in made.collect()} == {e: float(d) for e, d in edges.items()}
    forest = D.spanning_forest(made)
    assert sorted((r.d, r.a, r.b) for r in forest.collect()) == sorted(forest_of(edges))
    got = defaultdict(list)
    for r in D.density_clusters(made, 8).collect():
        got[r.cluster].append(r.node)
    noise = got.pop(None, [])
    want = plain(edges, len(p), 8)
    assert sorted(sorted(v) for v in got.values()) == want and len(want) >= 2
    assert all(name == min(v) for name, v in got.items())
    assert len(noise) == len(p) - sum(map(len, want))


def test_noise_near_a_centroid_is_attached(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, [-1.0, 0.0]), (5, [0.0, 0.0])], "id long, v array<double>")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, None), (5, None)], "node long, cluster long")
    centres = D.centroids_of(rows.join(clusters.filter("cluster is not null"), F.col("id") == F.col("node")).select("cluster", "v"))
    got = {r.id: (r.cluster, r.attached) for r in D.attach_noise(rows, clusters, centres, 0.87).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (1, True), 4: (None, False), 5: (None, False)}


def test_clusters_with_like_centroids_are_joined(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (7, 7), (9, None)], "node long, cluster long")
    centres = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.99, 0.05]), (7, [0.0, 1.0])], "cluster long, centroid array<double>")
    assert {r.node: r.cluster for r in D.merge_alike(clusters, centres, 0.95).collect()} == {1: 1, 2: 1, 5: 1, 7: 7, 9: None}
