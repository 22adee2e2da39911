"""Exact dedup, mixing, SimHash, language ID and byte-level BPE against plain versions of the same contracts."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from factweave.llm import bpe, exact_dedup, langid, mixing, simhash
from factweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, salt int, u string"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, "Same Text here and there", "en", "a", 24),
    (4, "same text HERE and there", "en", "a", 24),
    (5, "ÉCOLE école", "fr", "é", 11),
    (6, "école école", "fr", "\U0001f600", 11),
    (7, "word " * 30000, "en", "a", 150000),
    (8, "\t\x0b \n", "en", "", 4),
    (9, "naïve     x \U0001f600 'll 12345 don't", "en", "b", 10),
    (3, "Same Text here and there", "en", "a", 24),
    (None, "no id at all", "en", "a", 12),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_awkward(awkward):
    groups = defaultdict(list)
    for r in AWKWARD:
        groups[low(r[1])].append(r[0])
    got = sorted(map(tuple, exact_dedup.exact_dedup(awkward).collect()), key=str)
    want = []
    for r in AWKWARD:
        ids = groups[low(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(low(r[1]).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_compares_texts_when_digests_clash(spark):
    rows = [(i, random.Random(i % 17).choice("abc") * (i % 17)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    want = {i: (max(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows}
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, salts=3, digest=weak).collect()}
    assert got == want


def test_exact_dedup_stage(spark, awkward):
    kept = exact_dedup.stage_exact_dedup(spark, awkward, "")
    assert kept.columns == awkward.columns
    texts = [low(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts))


def plain_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in open_}
        target |= {s: cap * sizes[s] for s in above}
        open_ -= above
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, 7, 100, 100, 5000]) for s in ["a", "b", "B", "é", None, "\U0001f600", "", "z"][: 3 + seed]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == pytest.approx(plain_targets(sizes, (3, 1, 2), 1.5, 2.0))


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randint(0, 40), rnd.choice(["a", "a", "a", "b", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("quality_weight"))
    mix = mixing.mix_sources(docs, quality=quality, ranges=64).collect()
    assert len(mix) == 3000
    again = mixing.mix_sources(docs.repartition(5), quality=quality, ranges=64).collect()
    assert sorted(map(str, mix)) == sorted(map(str, again))
    for source in ("a", "b", None):
        own = sorted((r for r in mix if r.source == source), key=lambda r: (r.key, r.doc_id))
        size, target = own[0].source_size, own[0].target
        assert size == sum(r.size for r in own)
        epochs, upto = int(target // size), 0
        for r in own:
            upto += r.size
            assert r.taken == r.size * (epochs + (upto - r.size / 2 <= target - epochs * size))
        assert abs(sum(r.taken for r in own) - target) <= 20


def test_mixing_prefers_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    quality = docs.select("doc_id", F.when(F.col("doc_id") < 2000, 3.0).otherwise(1.0).alias("quality_weight"))
    mix = mixing.mix_sources(docs, quality=quality, share=0.5).filter("taken > 0")
    good = mix.filter("doc_id < 2000").count() / mix.count()
    assert 0.62 < good < 0.78


def test_mixing_awkward(spark, awkward, empty):
    rows = mixing.mix_sources(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.size for r in rows if r.doc_id in (1, 2, 8)} == {0}
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low(text))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(awkward):
    for text in [r[1] for r in AWKWARD] + ["a", "a b", "a b c", "a b c d", "x\x1cy z\x85w q"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover():
    rnd = random.Random(1)
    free = sum(1 << b for b in rnd.sample(range(64), 40))
    masks = simhash.covering_masks(free, 2)
    assert all(m & ~free == 0 for m in masks)
    bits = [b for b in range(64) if free >> b & 1]
    assert all(any(not m & (1 << a | 1 << b) for m in masks) for a in bits for b in bits)


def plain_components(prints):
    ids = sorted(prints)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in ids}


def test_near_edges_in_large_buckets(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    near = {base ^ sum(1 << b for b in rnd.sample(range(20), rnd.randint(0, 5))) for _ in range(900)}
    prints = {i: p for i, p in enumerate(sorted(near) + [rnd.getrandbits(64) for _ in range(100)])}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints.values()], "fp long")
    got = {(min(r), max(r)) for r in simhash.near_edges(df).distinct().collect()}
    fps = [simhash.signed(p) for p in prints.values()]
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_near_groups_on_given_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_components(prints)
    got = simhash.near_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == prints


def test_near_groups_awkward(spark, awkward, empty):
    got = simhash.near_groups(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 8)} == {1}
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.stage_simhash(spark, awkward, "")
    assert kept.columns == awkward.columns and kept.filter("doc_id in (1, 2, 8)").count() == 1


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(1299, 2000), (5, 5)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(201)} | {i: 1000 for i in [*range(1000, 1300), 2000]}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_language_rules(spark, awkward, empty):
    said = langid.identify(awkward).collect()
    assert len(said) == len(AWKWARD)
    for r in said:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id in (1, 2, 8):
            assert r.lang_pred == "und"
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_grams(text):
    line = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    line = " " + " ".join(line.split()) + " "
    grams = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    del grams[" "]
    return grams


def test_gram_counts():
    text = "L'École élémentaire, 12 mots; ÇA va?"
    values, counts = langid.gram_counts(text)
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert dict(zip(values.tolist(), counts.tolist())) == {code(g): n for g, n in plain_grams(text).items()}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right, n = said.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.95


def test_bpe_as_tiktoken(spark, awkward, empty):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rnd = random.Random(2)
    odd = [(10_000 + i, "".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x3000, 0xD7FF), rnd.randint(0x1F300, 0x1F6FF), 32, 32])) for _ in range(rnd.randint(1, 300)))) for i in range(150)]
    odd += [(1, "<|endoftext|>" * 3), (2, "a" * 5000), (3, " " * 3000), (4, "\x00\x7f 's'S")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).unionByName(awkward.select("doc_id", "text"))
    texts = [r.text for r in rows.collect()]
    full = bpe.encode_decode(rows).collect()
    short = bpe.encode_decode(rows, digests=True).collect()
    for text, a, b in zip(texts, full, short):
        ids = known.encode_ordinary(text or "")
        assert a.ids == ids and a.n_tokens == b.n_tokens == len(ids) and bytes(a.decoded) == (text or "").encode()
        assert b.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert b.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(empty).count() == 0


def test_rank_file_is_read_whole():
    path = public_tokenizers.path(bpe.VOCABULARY)
    with open(path, "rb") as lines:
        assert bpe.read_ranks(path) == {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in lines}
