"""Communities by modularity against a plain Louvain that moves one node at a time."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from factweave.operators import louvain as L


def plain(edges, seed=42):
    """The communities and the modularity that they have."""
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        if a != b:
            near[a][b] += w
            near[b][a] += w
    whole = {n: dict(d) for n, d in near.items()}
    m = sum(sum(d.values()) for d in whole.values())
    part, graph, loop, rng = {n: n for n in whole}, whole, defaultdict(float), random.Random(seed)
    while True:
        degree = {n: sum(d.values()) + 2 * loop[n] for n, d in graph.items()}
        own, total, changed, moved = {n: n for n in graph}, dict(degree), False, True
        while moved:
            moved = False
            order = sorted(graph)
            rng.shuffle(order)
            for n in order:
                to = defaultdict(float)
                for x, w in graph[n].items():
                    to[own[x]] += w
                total[own[n]] -= degree[n]
                best = max([own[n], *sorted(to)], key=lambda c: round(to.get(c, 0.0) - degree[n] * total[c] / m, 12))
                total[best] += degree[n]
                if best != own[n]:
                    own[n], moved, changed = best, True, True
        part = {n: own[p] for n, p in part.items()}
        if not changed:
            return part, quality(edges, part)
        fewer, inside = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for n, d in graph.items():
            inside[own[n]] += loop[n]
            fewer[own[n]]
            for x, w in d.items():
                if own[n] == own[x]:
                    inside[own[n]] += w / 2
                else:
                    fewer[own[n]][own[x]] += w
        graph, loop = {n: dict(d) for n, d in fewer.items()}, inside


def quality(edges, part):
    m, inside, total = 0.0, 0.0, defaultdict(float)
    for a, b, w in edges:
        if a != b:
            m += 2 * w
            inside += 2 * w * (part[a] == part[b])
            total[part[a]] += w
            total[part[b]] += w
    return inside / m - sum(t * t for t in total.values()) / m**2


def planted(n, groups, within, between, seed):
    rng = random.Random(seed)
    return [(a, b, 1.0 + rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < (within if a % groups == b % groups else between)]


def test_modularity_is_that_of_the_plain_form(spark):
    edges = [*planted(48, 4, 0.4, 0.04, 1), (3, 3, 2.0), (500, 501, 1.0), (500, 501, 0.5)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3)
    found = L.louvain(df)
    part = {r.node: r.community for r in found.collect()}
    best = max(plain(edges, s)[1] for s in (1, 2, 3))
    assert quality(edges, part) >= 0.98 * best
    assert set(part) == {n for a, b, _ in edges if a != b for n in (a, b)}
    assert part[500] == part[501] == 500 and all(part[c] == c and c == min(n for n in part if part[n] == c) for c in part.values())
    assert abs(L.modularity(L.both_ways(df), found) - quality(edges, part)) < 1e-9


def test_largest_component(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (5, 6, 1.0), (6, 7, 1.0), (9, 8, 1.0)], "src long, dst long, weight double")
    assert sorted(r.src for r in L.giant_component(df).collect()) == [5, 6]
    assert L.louvain(df.filter(F.lit(False))).count() == 0
