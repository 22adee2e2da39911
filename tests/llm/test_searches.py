"""Hard negatives, exact top-k and ranked lexical search against plain versions, on tables with nulls, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import bag_search, hard_negatives, maxscore, registry, vector_blocks

SF = "/root/testdata/sf0.001"
CLASH = "id int, v string, notes int, rank int, score int, n int, m int, key string, term string, part int, vector string, `a.b` int"
EXTRA = (1, "x", 2, 3, 4, 5, 6, "k", "t", 7, "w", 8)


def vectors(seed=3, n=330):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-1, 0, 0, 1]) * rng.random() for _ in range(6)]
        rows.append((i, v if i % 9 else [float(round(x)) for x in v], rng.randrange(3)))  # whole numbers make ties
    rows += [(i, list(rows[i][1]), rows[i][2]) for i in (100, 5, 6)]  # repeated rows
    rows += [(400, None, 1), (500, [1.0, None, 0.0], 1), (600, [1.0, float("nan")], 2), (700, [float("inf")], 2), (800, [0.5, 0.25], None), (None, [1.0] * 6, 1)]
    rows += [(900, [0.5, -0.25], 1), (1000, [], 0), (1100, [0.0] * 6, 2), (1101, [-1.0] * 6, 2)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id long, embedding array<double>, label int, {CLASH}").repartition(parts)


def whole(rows, scale):
    good = [(i, v, lab) for i, v, lab in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in good]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.fixture
def small_lists(monkeypatch):
    """Many lists, and a first round that has some of them."""
    for name, value in (("ROWS", 16), ("QUERIES", 2), ("SAMPLE", 3)):
        monkeypatch.setattr(vector_blocks, name, value)


def test_top_k_as_plain(spark, small_lists):
    rows = vectors()
    plain = whole(rows, 1024)
    want = []
    for q, v in sorted({i: v for i, v, _ in plain if i % 100 == 0}.items()):
        found = sorted((-dot(v, w), i) for i, w, _ in plain if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    df = frame(spark, rows)
    got = maxscore.top_k(df, df.filter("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_as_plain(spark, small_lists):
    rows = vectors()
    plain = [r for r in whole(rows, 256) if r[2] is not None]
    want = []
    for q, v, lab in {i: (i, v, lab) for i, v, lab in plain if i % 100 == 0}.values():
        positives = sorted((-dot(v, w), i) for i, w, other in plain if i != q and other == lab)[:5]
        for s, p in positives:
            p_score = -s
            found = sorted((-dot(v, w), i) for i, w, other in plain if i != q and other != lab and 30 * p_score <= 100 * dot(v, w) <= 90 * p_score)[:10]
            want += [(q, p, k, i, p_score, -n) for k, (n, i) in enumerate(found, 1)]
    df = frame(spark, rows)
    got = hard_negatives.hard_negatives(df, df.filter("vec_id % 100 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 26])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-size, size, (50, 7)), rng.integers(-size, size, (9, 7))
    packed = hard_negatives.Packed(rows)
    for a in anchors:
        assert packed.scores(a.tolist()).tolist() == (rows @ a).tolist()


@pytest.mark.parametrize("least", [None, -50, 0, 1, 900, 10**6])
def test_shard_leaves_out_no_competing_row(least):
    rng = np.random.default_rng(1)
    rows = rng.integers(-30, 30, (200, 20)) * (rng.random((200, 20)) < 0.3)
    shard = maxscore.Shard(rows)
    for query in rng.integers(-30, 30, (20, 20)):
        met, got = shard.search(query, least)
        exact = rows @ query
        assert got.tolist() == exact[met].tolist()
        if least is not None:
            assert set(np.flatnonzero(exact >= least)) == set(met.tolist())


def test_too_large_components_are_refused():
    with pytest.raises(ArithmeticError):
        vector_blocks.fits(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31))


def test_vectors_empty(spark):
    none = frame(spark, [], 1)
    some = frame(spark, vectors(n=120))
    for a, b in ((none, none), (some, none), (none, some)):
        assert maxscore.top_k(a, b).count() == 0
        assert hard_negatives.hard_negatives(a, b).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(found(t))) for i, t in docs if found(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in found(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


WORDS = ["the", "The", "naïve", "ß", "x1", "été", "\U0001f600", "of", "rare", "zeta", "mu"]


def texts(seed=5, n=300):
    rng = random.Random(seed)
    docs = [(i, " ,.;\n"[rng.randrange(5)].join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))) for i in range(n)]
    docs += [(1000 + i, "the same copy of rare words") for i in range(60)] + [(5, "the same copy of rare words"), (None, "the same copy of rare words"), (None, None)]
    return docs + [(2000, None), (2001, ""), (2002, " !?\x00\x7f"), (2003, "mu " * 40000), (2004, "word " * 3000 + "zeta")]


@pytest.mark.parametrize("parts", [False, True])
def test_search_as_plain(spark, monkeypatch, parts):
    if parts:
        for name, value in (("TERMS", 4), ("POSTINGS", 6), ("SCORES", 20)):
            monkeypatch.setattr(bag_search, name, value)
    docs = texts()
    items = [(1, "the rare COPY of zeta"), (2, "nothing known"), (3, None), (4, ""), (5, "été été naïve été"), (6, "MU mu \U0001f600 x1"), (6, "same"), (None, "ß of")]
    d = spark.createDataFrame([(*r, *EXTRA) for r in docs], f"doc_id long, text string, {CLASH}").repartition(4)
    i = spark.createDataFrame([(*r, *EXTRA) for r in items], f"item_id long, text string, {CLASH}").repartition(2)
    got = bag_search.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(docs, items, 20))


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    items = docs.withColumnRenamed("doc_id", "item_id")
    for a, b in ((none, items), (docs, items.limit(0)), (none, items.limit(0))):
        assert bag_search.search(a, b).count() == 0


def test_vectors_of_frequencies_round_trip():
    for numbers, counts in (([], []), ([0], [1]), ([1, 300, 70000], [1, 2, 3]), ([5, 1 << 40], [1 << 20, 1])):
        a, b = bag_search.decoded(bag_search.encoded(numbers, counts))
        assert (a.tolist(), b.tolist()) == (numbers, counts)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_maxscore", "op13_bag_search"])
def test_queries_against_sql(spark, name):
    connection = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = connection.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_repeated_queries_ask_once(spark):
    rows = frame(spark, [(100, [1.0, 0.0], 1), (100, [0.5, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.25, 0.0], 2)])
    got = maxscore.top_k(rows, rows.filter(F.col("vec_id") == 100)).collect()
    assert sorted((r.vec_id, r.score) for r in got) == [(1, 512 * 1024), (2, 512 * 256)]
