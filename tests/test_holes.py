"""Structural holes on graphs whose ids say nothing about who is linked."""

import random
from collections import defaultdict

from factweave.operators import holes


def shuffled(spark, work):
    """What work gives, and how many bytes its run shuffled."""
    def total():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = total()
    return work(), total() - before


def plain(links):
    near = defaultdict(dict)
    for a, b in links:
        near[a][b] = near[b][a] = near[a].get(b, 0) + 1.0
    share = {i: {j: w / sum(d.values()) for j, w in d.items()} for i, d in near.items()}
    out = {}
    for i, d in share.items():
        twice = sum(len(near[i].keys() & near[j].keys()) for j in d)
        constraint = sum((p + sum(d[q] * share[q][j] for q in near[i].keys() & near[j].keys())) ** 2 for j, p in d.items())
        out[i] = (len(d), twice // 2, round(twice / (len(d) * (len(d) - 1)) if len(d) > 1 else 0.0, 9), round(constraint, 9))
    return out


def test_blocks_of_a_mixed_graph_send_links_in_proportion_to_groups(spark, monkeypatch):
    rng = random.Random(3)
    links = [(a, b) for a, b in ((rng.randrange(1500), rng.randrange(1500)) for _ in range(40_000)) if a != b]
    links += [(0, n) for n in range(1, 1500)]  # a hub
    df = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double").repartition(4)
    want, sizes = plain(links), []
    for kept in (80_000, 5_000):
        monkeypatch.setattr(holes, "LINKS", kept)
        rows, size = shuffled(spark, lambda: holes.structural_holes(df).collect())
        assert {r.node: (r.neighbours, r.triangles, round(r.clustering, 9), round(r.constraint, 9)) for r in rows} == want
        sizes.append(size)
    assert sizes[1] < 10_000_000  # one list for a node, slice and group, not each link for each block (12.9 MB)
