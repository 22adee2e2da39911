"""Values, orders, chunks, links and graph measures on cases of their own, and against plain versions."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import chunks, communities, ordering, values
from factweave.plans import registry
from factweave.plans.language import luhn_valid

registry.load()

COMPARED = [
    ("30 min", "30 min", 0.0, "SUPPORTS"), ("30 min", "31 min", 0.05, "SUPPORTS"), ("30 min", "40 min", 0.05, "CONTRADICTS"), ("30 min", "30 kg", 0.0, "UNKNOWN"),
    ("25", "between 20 and 30", 0.0, "SUPPORTS"), ("35", "20-30", 0.0, "CONTRADICTS"), ("20", "20 to 30", 0.0, "SUPPORTS"), ("10", "10, 20, 30", 0.0, "PARTIAL"), ("15", "10, 20, 30", 0.0, "CONTRADICTS"),
    ("20", "at most 30", 0.0, "SUPPORTS"), ("40", "<= 30", 0.0, "CONTRADICTS"), ("40", "at least 30", 0.0, "SUPPORTS"), ("20-30", "20-30", 0.0, "SUPPORTS"), ("20-30", "25-40", 0.0, "PARTIAL"), ("20-30", "31-40", 0.0, "CONTRADICTS"),
    ("20-30", "25", 0.0, "PARTIAL"), ("20-30", "35", 0.0, "CONTRADICTS"), ("1, 2, 3", "3, 2, 1", 0.0, "SUPPORTS"), ("1, 2", "1, 2, 3", 0.0, "PARTIAL"), ("1, 9", "1, 2, 3", 0.0, "PARTIAL"), ("8, 9", "1, 2, 3", 0.0, "CONTRADICTS"),
    ("1, 2", "2", 0.0, "PARTIAL"), ("at most 30", "at most 30", 0.0, "SUPPORTS"), ("at most 40", "at most 30", 0.0, "SUPPORTS"), ("at most 20", "at most 30", 0.0, "CONTRADICTS"), ("at most 20", "at least 20", 0.0, "CONTRADICTS"),
    ("at most 30", "30", 0.0, "SUPPORTS"), ("at least 30", "29", 0.0, "CONTRADICTS"), ("enabled", "yes", 0.0, "SUPPORTS"), ("enabled", "disabled", 0.0, "CONTRADICTS"), ("v1.2.3", "v1.2.3", 0.0, "SUPPORTS"), ("v1.2", "v1.2.9", 0.0, "SUPPORTS"),
    ("v1.2.3", "v2.0.0", 0.0, "CONTRADICTS"), ("red", " RED", 0.0, "SUPPORTS"), ("red", "blue", 0.0, "UNKNOWN"), ("enabled", "30", 0.0, "UNKNOWN"), (None, "30", 0.0, "UNKNOWN"), ("0", "0.05", 0.1, "SUPPORTS"),
]


def test_comparison_of_kinds(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(COMPARED)], "i int, a string, c string, tol double, want string")
    got = df.select("i", "a", "c", "want", values.compare(values.parse(F.col("a")), values.parse(F.col("c")), F.col("tol"))["verdict"].alias("got")).orderBy("i").collect()
    assert [(r.a, r.c, r.got) for r in got] == [(r.a, r.c, r.want) for r in got]


def test_tolerance(spark):
    rows = [("HIGH", True, 1.0, 0.05, 0.0), ("LOW", False, 1.0, 0.05, 0.0), ("LOW", True, 0.0, 0.05, 0.05), ("MEDIUM", True, 0.5, 0.05, 0.0625), ("LOW", True, 1.0, 0.09, 0.1)]
    df = spark.createDataFrame(rows, "a string, x boolean, h double, b double, want double")
    for r in df.select("want", values.tolerance(F.col("a"), F.col("x"), F.col("h"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("a limit of 1500 lb", "6.67 kN at most", True), ("1,500 lb", "680 kg", True), ("1 500 lb", "900 kg", False), ("25.4 mm", "1 inch", True), ("5 s", "5000 ms", True), ("5 s", "5 kg", False), ("10 m/s", "36 km/h", True),
        ("5 s and 2 kg", "5000 ms", True), ("5 s and 7 s", "5 s", False), ("no numbers", "5 s", False), (None, "5 s", None),
    ],
)
def test_equal_quantities(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert bool(df.select(values.equivalent(values.quantities(F.col("a")), values.quantities(F.col("b"))).alias("x")).first().x) == bool(want)


@pytest.mark.parametrize(
    "found,strategy,order",
    [
        (["1.10", "1.2", "v1.9.1"], "semver", ["1.2", "v1.9.1", "1.10"]), (["2021", "2019"], "year", ["2019", "2021"]), (["2021 FPS02", "2021", "2020"], "year_pack", ["2020", "2021", "2021 FPS02"]), (["10", "9", "2.5"], "semver?", None),
        (["10", "9"], "numeric", ["9", "10"]), (["IV", "ii", "IX"], "roman", ["ii", "IV", "IX"]), (["Second", "first"], "ordinal", ["first", "Second"]), (["Enterprise", "basic"], "edition", ["basic", "Enterprise"]), (["red", "blue"], "unknown", None), (["2021"], "unknown", None),
    ],
)
def test_orders_of_values(spark, found, strategy, order):
    df = spark.createDataFrame([("x", v) for v in found], "axis string, value string")
    rows = ordering.infer_order(df, "axis", "value").collect()
    if strategy == "semver?":  # numbers, of which one looks like a version: numeric is the first that fits all
        assert {r.strategy for r in rows} == {"numeric"}
        return
    assert {r.strategy for r in rows} == {strategy}
    assert order is None and all(r.key is None for r in rows) or [r.value for r in sorted(rows, key=lambda r: r.key)] == order


def test_revisions(spark):
    rows = [("AC 25.785-1A", "AC 25.785-1", "A"), ("ETSO-C127C", "ETSO-C127", "C"), ("AC 21-25", "AC 21-25", ""), ("AC 21-49", "AC 21-49", ""), ("Policy", "Policy", "")]
    df = spark.createDataFrame(rows, "k string, base string, rev string")
    assert df.filter((ordering.family(F.col("k")) != F.col("base")) | (ordering.revision(F.col("k")) != F.col("rev"))).count() == 0


def test_card_numbers(spark):
    rows = [("4111 1111 1111 1111", True), ("4111-1111-1111-1112", False), ("5500000000000004", True), ("1234567812345678", False)]
    df = spark.createDataFrame(rows, "n string, want boolean")
    assert df.filter(luhn_valid(F.col("n")) != F.col("want")).count() == 0


def test_words_of_any_script(spark):
    row = spark.createDataFrame([("L'École, 12 Über-Straße naïve",)], "t string").select(T.words(F.col("t")).alias("w")).first()
    assert row.w == ["l", "école", "12", "über", "straße", "naïve"]


def plain_chunks(rows, size, overlap):
    out, buffer = [], []

    def flush():
        if buffer:
            out.append(("narrative", buffer[0][0], buffer[-1][0], sum(len(x[2]) for x in buffer)))

    for pos, kind, line in rows:
        if kind in ("heading", "paragraph"):
            buffer.append((pos, kind, line))
            if sum(len(x[2]) for x in buffer) >= size:
                flush()
                buffer[:] = buffer[-max(1, int(len(buffer) * overlap)) :]
        else:
            flush()
            buffer.clear()
            out.append((kind, pos, pos, len(line)))
    flush()
    return out


@pytest.mark.parametrize("size,overlap", [(100, 0.15), (60, 0.5), (1, 0.0)])
def test_chunks_by_type(spark, size, overlap):
    rnd = random.Random(size)
    docs = {d: [(p, rnd.choice(["heading", "paragraph", "paragraph", "table", "code"]), "x" * rnd.randint(1, 60)) for p in range(rnd.randint(1, 30))] for d in range(12)}
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc_id long, pos long, kind string, line string").repartition(5)
    got = defaultdict(list)
    for r in chunks.type_aware_chunks(df, size=size, overlap=overlap).orderBy("doc_id", "chunk").collect():
        got[r.doc_id].append((r.kind, r["first"], r["last"], r.chars))
    assert got == {d: plain_chunks(rows, size, overlap) for d, rows in docs.items()}
    assert chunks.type_aware_chunks(df.limit(0)).count() == 0


def test_procedure_links_are_greedy(spark, tmp_path):
    rows = [(1, 0, "user", "open the red valve. close the red valve."), (1, 1, "assistant", "You open the red valve first. Then close it. Weather is fine today."), (2, 0, "user", "hello there friend"), (2, 1, "assistant", "completely different words")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in registry.QUERIES["procedure_links"](spark, str(tmp_path)).collect()]
    assert got == [(1, 0, 0, 1, 0, pytest.approx(4 / 6, abs=1e-6))]


def plain_betweenness(edges, sources, depth):
    near, total = defaultdict(set), defaultdict(float)
    for a, b in edges:
        if a != b:
            near[a].add(b)
    for s in sources:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in sorted(near[v]):
                if w not in dist and dist[v] < depth:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist.get(w) == dist[v] + 1:
                    paths[w] += paths[v]
        delta = defaultdict(float)
        for v in reversed(order):
            for w in near[v]:
                if dist.get(w) == dist[v] + 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if v != s and delta[v]:
                total[v] += delta[v]
    return total


def test_betweenness_and_communities(spark):
    rnd = random.Random(4)
    edges = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(70)} | {(100, 101), (101, 102)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    sources = spark.createDataFrame([(0,), (5,), (100,)], "node long")
    got = {r.node: r.betweenness for r in communities.betweenness(df, sources, 4).collect()}
    want = plain_betweenness(edges, [0, 5, 100], 4)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    labels = {r.node: r.community for r in communities.label_propagation(df.filter("src >= 100"), 4).collect()}
    assert set(labels) == {100, 101, 102}
    score = communities.centrality(df, sources, 5, 4).collect()
    assert all(0 <= r.score <= 1 for r in score) and max(r.degree for r in score) == 1


def test_themes(spark):
    rnd = random.Random(2)
    rows = [(i, [10.0 * (i % 3) + rnd.random(), 5.0 * (i % 3) + rnd.random()]) for i in range(60)]
    got = communities.themes(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 2, 5).collect()
    assert {r.k for r in got} == {3}
    assert all(len({r.theme for r in got if r.id % 3 == g}) == 1 for g in range(3))
