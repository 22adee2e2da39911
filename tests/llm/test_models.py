"""Importance weights and rank-order profiles against plain versions of their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from factweave.llm import langid, quality
from test_core_operators import plain_grams


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_buckets(text):
    mask = (1 << 64) - 1
    words = [zlib.crc32(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+", (text or "").encode().lower())]
    hashed = [w * 0x9E3779B97F4A7C15 & mask for w in words]
    hashed += [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & mask for a, b in zip(words, words[1:])]
    return [(h >> 50) % quality.BUCKETS for h in hashed]


def plain_weights(docs, good):
    raw, target = Counter(), Counter()
    for i, text in docs:
        found = plain_buckets(text)
        raw.update(found)
        if i in good:
            target.update(found)
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n)
    return [sum(map(ratio, plain_buckets(t))) if good else 0.0 for _, t in docs]


def test_importance_weights_and_cut(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in given] + [(None, "no id"), (None, None), (5_000, ""), (5_001, "ÉCOLE école 12!!")]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    known = {i: q for i, q in labels.items() if not held_out(i)}
    good = {i for i, q in known.items() if q}
    share = sum(map(bool, known.values())) / len(known)
    want = plain_weights(docs, good)
    keys = []
    for (i, _), w in zip(docs, want):
        u = (int(hashlib.md5(f"0|gumbel|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        keys.append(w - math.log(-math.log(u)))
    got = quality.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert len(got) == len(docs)
    for (i, text), w, k in zip(docs, want, keys):
        r = min(by_id[i], key=lambda r: abs(r.key - k))
        assert (r.log_weight, r.key, r.n_grams) == (pytest.approx(w, abs=1e-6), pytest.approx(k, abs=1e-6), len(plain_buckets(text)))
    order = sorted(zip(keys, docs), key=lambda x: -x[0])
    kept = Counter(d[0] for _, d in order[: round(share * len(docs))])
    assert Counter(r.doc_id for r in got if r.kept) == kept


def plain_profile(grams, top):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    order = sorted(grams, key=lambda g: (-grams[g], code(g)))[:top]
    return {g: r for r, g in enumerate(order)}


def plain_language(text, profiles, top):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    own = plain_profile(plain_grams(text), top)
    distance = {lang: sum(min(abs(p[g] - r), top) if g in p else top for g, r in own.items()) for lang, p in profiles.items()}
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (top * len(own))


@pytest.mark.parametrize("top", [30, 400])
def test_profiles_and_distance(spark, top):
    rnd = random.Random(top)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in rnd.sample(given, 80)]
    rows += [(9_000, None, "en"), (9_001, "123", "fr"), (9_002, "Ein Wort", None), (None, "sans nom", "fr")]
    grams = defaultdict(Counter)
    for i, text, lang in rows:
        if lang and text is not None and not held_out(i):
            grams[lang].update(plain_grams(text))
    profiles = {lang: plain_profile(g, top) for lang, g in grams.items() if g}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(docs, top=top).collect()}
    for i, text, _ in rows:
        lang, score = plain_language(text, profiles, top)
        assert (got[i].lang_pred, got[i].score) == (lang, pytest.approx(score)), text
