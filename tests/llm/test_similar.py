"""Near duplicates at a similarity against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from factweave.llm import covering, similar, simhash
from test_core_operators import low


def plain_shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_groups(texts, tenths=8):
    """texts by id. The smallest id that links of similarity tenths / 10 or more reach, for every id."""
    ids, sets = sorted(texts), {i: plain_shingles(t) for i, t in texts.items()}
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and 10 * len(sets[a] & sets[b]) >= tenths * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in ids}


def near_copies(seed):
    """Copies of a few texts with some words changed, put in or left out, so that similarities lie on both sides of 0.8; a passage that many share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(12)]
    out = [None, "", " \t ", "one", "ONE", "one two three four", "a b c d e", "a b c d e f", "x y z a b c d e f g h"]
    for _ in range(5):
        base = [word() for _ in range(rnd.choice([12, 40, 150, 400]))]
        if rnd.random() < 0.6:
            base += passage
        for _ in range(40):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                i = rnd.randrange(len(copy))
                copy[i : i + rnd.randint(0, 1)] = [word() for _ in range(rnd.randint(0, 2))]
            out.append(" ".join(copy))
    out += [" ".join([word() for _ in range(20)] + passage) for _ in range(40)]
    out += [" ".join(passage)] * 3
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed,part", [(1, 2048), (2, 16), (3, 3)])
def test_groups_against_all_pairs(spark, monkeypatch, seed, part):
    monkeypatch.setattr(similar, "PART", part)
    texts = dict(enumerate(near_copies(seed)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, rid string").repartition(5)
    got = {r.key: r.component for r in similar.similar_groups(docs, "doc_id").collect()}
    want = plain_groups(texts)
    assert {i: got.get(i, i) for i in texts} == want
    assert len(set(want.values())) < len(texts) - 50
    assert similar.similar_groups(docs.limit(0), "doc_id").count() == 0


def test_every_similar_pair_shares_a_mask_and_passes_the_parities():
    rnd = random.Random(6)
    seen = np.zeros(similar.COUNTERS, np.int64)
    texts = [t for t in near_copies(7) if t]
    sets = [similar.shingles(t, 5) for t in texts]
    for s in sets:
        np.add.at(seen, (s % np.uint64(similar.COUNTERS)).astype(np.int64), 1)
    signed = [similar.signature(s, seen, 8) for s in sets]
    found = 0
    for _ in range(20_000):
        i, j = rnd.randrange(len(texts)), rnd.randrange(len(texts))
        common = np.intersect1d(sets[i], sets[j]).size
        if i != j and 10 * common >= 8 * (sets[i].size + sets[j].size - common):
            found += 1
            assert np.intersect1d(signed[i][0], signed[j][0]).size
            differing = (int.from_bytes(signed[i][2], "big") ^ int.from_bytes(signed[j][2], "big")).bit_count()
            assert 18 * differing <= 2 * (sets[i].size + sets[j].size)
    assert found > 100


def test_shingles_are_those_of_the_text():
    for t in near_copies(3):
        assert similar.shingles(t, 5).size == len(plain_shingles(t))


def test_the_stage_drops_near_copies(spark):
    texts = dict(enumerate(near_copies(4)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()}
    assert kept == set(plain_groups(texts).values())
    groups = defaultdict(set)
    for i, g in plain_groups(texts).items():
        groups[g].add(i)
    assert all(len(kept & g) == 1 for g in groups.values())


def test_parities_of_any_sizes_differ_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for sizes in ((1, 1), (3, 700), (900, 1000), (5000, 4000)):
        common = rng.integers(0, 1 << 63, min(sizes) // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - common.size, dtype=np.uint64)])) for n in sizes)
        differing = similar.parities_differ(similar.parities(a), similar.parities(b))
        assert differing == similar.parities_differ(similar.parities(b), similar.parities(a))
        assert differing <= np.setxor1d(a, b).size
        assert similar.parities_differ(similar.parities(a), similar.parities(a)) == 0
        if min(sizes) > 500:  # and tells most differing members apart
            assert differing > 0.7 * np.setxor1d(a, b).size


def test_simhash_finds_links_before_the_prefixes(spark):
    """Links of fingerprints within the radius, by brute force, are among the pairs that the masks give; all links come out in the end."""
    texts = dict(enumerate(near_copies(5)))
    prints = {i: covering.majority(similar.shingles(t, 5)) for i, t in texts.items()}
    signed = spark.createDataFrame([(i, covering.signed(p)) for i, p in prints.items()], "rid long, fp long")
    got = {(r.a, r.b) for r in similar.print_pairs(signed).collect()}
    assert all(a < b and (prints[a] ^ prints[b]).bit_count() <= similar.RADIUS for a, b in got)
    first = {p: min(i for i in prints if prints[i] == p) for p in prints.values()}
    want = {(min(first[p], first[q]), max(first[p], first[q])) for p in first for q in first if p < q and (p ^ q).bit_count() <= similar.RADIUS}
    want |= {(first[p], i) for i, p in prints.items() if first[p] != i}
    assert got == want and len(got) > 30
    groups = plain_groups(texts)
    assert sum(groups[a] == groups[b] for a, b in got) > 30


def test_many_fingerprints_in_one_bucket_at_the_stages_radius(spark):
    rnd = random.Random(8)
    fps = sorted({rnd.getrandbits(12) | 7 << 40 for _ in range(700)})
    got = {(r.u, r.v) for r in covering.near_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), similar.RADIUS, similar.SMALL).distinct().collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= similar.RADIUS}
