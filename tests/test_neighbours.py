"""The nearest rows of every row, against all pairs, and what that shuffles."""

import numpy as np
import pytest
from test_growth import shuffled

from factweave.operators import blocks as B
from factweave.plans import registry

registry.load()


@pytest.mark.parametrize("n,size,asking,least", [(150, 16, 40, None), (150, 8192, 1 << 17, 0.2), (3, 8192, 1 << 17, None), (0, 8192, 1 << 17, None)])
def test_neighbours_as_plain(spark, monkeypatch, n, size, asking, least):
    monkeypatch.setattr(B, "LIST", size)
    monkeypatch.setattr(B, "ASKING", asking)
    monkeypatch.setattr(B, "FEW", 30)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(n, 6)).round(3)
    if n > 100:
        m[20:50] = m[5]  # equal rows: ties are for the ids to break
        m[60] = 0
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    got = {}
    for r in B.neighbours(df, 7, least).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.similarity))
    u = B.unit(m)
    s = np.round(u @ u.T, 6) + 0.0
    for i in range(n):
        want = sorted((-s[i, j], j * 3) for j in range(n) if j != i and (least is None or s[i, j] >= least))[:7]
        assert sorted(got.pop(i * 3, [])) == [(p, j, -x) for p, (x, j) in enumerate(want, 1)]
    assert not got


def test_a_row_is_sent_to_groups_not_to_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(rng.normal(size=(3000, 32)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    from factweave.plans.indexed import neighbour_graph

    registry.QUERIES["neighbour_graph_of_test"] = neighbour_graph
    try:
        graph, size = shuffled(spark, "neighbour_graph_of_test", str(tmp_path))
    finally:
        del registry.QUERIES["neighbour_graph_of_test"]
    assert len(graph) == 8 * 3000
    assert size < 8_000_000  # 55 cells would have each row
