"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import repeats


def plain(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def made(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [text(rnd.randint(30, 120)) for _ in range(6)]
    out = [None, "", "a" * 199, "a" * 200, "b" * 201, "ab" * 400, "xyz " * 200, "c" * 900]
    for _ in range(40):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4)):
            s = rnd.choice(shared)
            a, b = sorted((rnd.randint(0, len(s)), rnd.randint(0, len(s))))
            parts += [rnd.choice([s, s[a:b]]), text(rnd.randint(0, 30))]
        out.append(rnd.choice(["", " "]).join(parts))
    base = text(150)
    for _ in range(15):  # near copies, with one letter changed
        i = rnd.randrange(len(base))
        out.append(base[:i] + "#" + base[i + 1 :])
    out += [base, base, text(2000) + base + text(10) + base]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed,most", [(0, 1024), (1, 1024), (2, 3), (3, 2)])
def test_as_brute_force(spark, seed, most):
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, anchor string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, digests=True, most=most).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_repeated_and_null_ids(spark):
    a, b = "one text that is long enough " * 8 + "A", "another text, quite different " * 8 + "B"
    rows = [(1, a), (1, a), (1, b), (None, b), (None, None), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect())
    want = Counter()
    for (doc_id, _), (n, removed, _, _) in zip(rows, plain([t for _, t in rows])):
        want[doc_id] += n - removed
    assert sum(got.values()) == len(rows)
    sizes = Counter()
    for (doc_id, kept), n in got.items():
        sizes[doc_id] += n * len(kept)
    assert sizes == want
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 1000)
    texts = made(7)
    found = []
    for owner, begin, pieces in repeats.text_pieces(texts):
        piece, first, last, anchor, _, _ = repeats.runs(pieces)
        starts = np.cumsum([0] + [len(p) for p in pieces])[:-1]
        for p, f, l in zip(piece, first, last):
            found += [(owner[p], begin[p] + s - starts[p]) for s in range(f, l + 1)]
    want = [(i, s) for i, t in enumerate(texts) for s in range(len((t or "").encode()) - 199)]
    assert sorted(found) == want


def test_common_prefix_hits():
    rnd = random.Random(3)
    base = bytes(rnd.choice(b"ab") for _ in range(repeats.REACH + repeats.WIDTH))
    contexts, firsts = [], []
    for _ in range(60):
        data = bytearray(base)
        for _ in range(rnd.randint(0, 2)):
            data[rnd.randrange(len(data))] = rnd.choice(b"cd")
        first = -rnd.randint(0, repeats.REACH)
        last = rnd.randint(first, 0)
        contexts.append(bytes(data[repeats.REACH + first : repeats.REACH + last + repeats.WIDTH]))
        firsts.append(first)
    hits = repeats.common_prefix_hits(contexts, np.array(firsts))
    window = lambda i, p: contexts[i][p - firsts[i] : p - firsts[i] + 200]
    for p in range(-repeats.REACH, 1):
        count = Counter(w for i in range(60) if firsts[i] <= p and len(w := window(i, p)) == 200)
        for i in range(60):
            w = window(i, p) if firsts[i] <= p else b""
            assert hits[i, p + repeats.REACH] == (len(w) == 200 and count[w] > 1)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows])))
    got = repeats.remove_repeats(docs.withColumn("extra", F.lit(1)), digests=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
