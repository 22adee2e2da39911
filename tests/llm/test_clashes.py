"""Columns that clash with helper names, maps, repeated and null ids, and the cut of the importance resampling."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from factweave.llm import exact_dedup, langid, mixing, quality, repeats, simhash

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
BASE = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", good int, _id int, _times int, _n int, `a.b` int, m map<string,int>, _row int, __row int, _which int, norm string, digest string, gone int, fp long, id int, key string, size int, n int"


def words(k):
    return " ".join(f"w{k}x{i} abc" for i in range(12))


def clashing(spark, rows):
    extra = (1, 77, 77, 77, 5, {"x": 1}, 8, 9, 10, "n", "d", 11, 12, 13, "k", 14, 15)
    return spark.createDataFrame([(*r, *extra) for r in rows], BASE + EXTRA).repartition(3)


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_keep_clashing_columns(spark, repeated):
    ids = [1, 1, 2, None, None, 3] if repeated else [1, 2, 3, 4, 5, 6]
    rows = [(i, words(k), "en", "a", 7) for k, i in enumerate(ids)]
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {(r.good, r._id, r._times, r._n, r["a.b"], r._row, r.gone, r.key) for r in got} <= {(1, 77, 77, 77, 5, 8, 11, "k")}
        if name != "source_mixing":
            assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in rows), name
    assert STAGES["byte_bpe"](spark, docs, SF).count() == len(rows)


def test_different_texts_of_one_id_stay(spark):
    rows = [(1, "alpha beta"), (1, "other text entirely"), (None, "x y"), (None, "p q r")]
    docs = clashing(spark, [(i, t, "en", "a", 1) for i, t in rows])
    for name in ("exact_dedup", "simhash_near_dedup"):
        assert Counter((r.doc_id, r.text) for r in STAGES[name](spark, docs, SF).collect()) == Counter(rows)


def test_operators_with_clashing_columns(spark):
    rows = [(i, words(i % 3), "en", "a", 7) for i in range(6)]
    docs = clashing(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0, 1) for i in range(6)], "doc_id long, quality int, toxic int, id int")
    assert quality.resample(docs, labels).count() == 6
    assert mixing.mix_sources(docs, quality=mixing.label_quality(labels)).count() == 6
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == 3
    assert simhash.near_groups(docs).count() == langid.identify(docs).count() == repeats.remove_repeats(docs).count() == 6


def test_language_stage_rejects_what_is_far_from_every_profile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(3)
    far = [(10_000_000 + i, "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(200)), None, "s", 200) for i in range(5)]
    far += [(10_000_100 + i, " ".join("".join(rnd.choice("qxzkjw") for _ in range(40)) for _ in range(20)), None, "s", 800) for i in range(5)]
    rows = docs.unionByName(spark.createDataFrame(far, docs.schema))
    kept = langid.stage_language_id(spark, rows, SF)
    assert kept.filter("doc_id >= 10000000").count() == 0
    assert kept.count() == docs.filter("text rlike '\\\\p{L}'").count()


def plain_largest(rows, share):
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, -(r[0] or 0)))
    return Counter(order[: round(share * len(rows))])


@pytest.mark.parametrize("kind", ["plain", "one key", "one id", "null ids", "few keys", "large ids"])
@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_cut_as_plain_version(spark, kind, share):
    rnd = random.Random(len(kind))
    make = {
        "plain": lambda i: (i, rnd.gauss(0, 100)),
        "one key": lambda i: (i, 1.5),
        "one id": lambda i: (7, rnd.choice([0.0, 1.0])),
        "null ids": lambda i: (rnd.choice([None, i]), rnd.choice([0.0, -1.0])),
        "few keys": lambda i: (i // 3, float(i % 4)),
        "large ids": lambda i: (2**62 + i if i % 2 else -(2**62) - i, 0.0),
    }[kind]
    rows = [make(i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, key double").repartition(5)
    got = quality.largest(df, share).collect()
    assert Counter((r.doc_id, r.key) for r in got) == Counter(rows)
    assert Counter((r.doc_id, r.key) for r in got if r.kept) == plain_largest(rows, share)


def test_mix_of_rows_that_repeat_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "AT_ONCE", 7)
    rows = [(1, "one two three", "a")] * 100 + [(None, "x y", "a")] * 50 + [(i, "z " * (i % 9), "b") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.mix_sources(docs, share=1.0, weights=(1, 3)).collect()
    assert len(mix) == len(rows)
    for source in "ab":
        own = [r for r in mix if r.source == source]
        size, target = own[0].source_size, own[0].target
        assert all(r.taken % r.size == 0 and r.taken <= 2 * r.size for r in own if r.size)
        assert abs(sum(r.taken for r in own) - target) <= 9
        epochs, upto = int(target // size), 0
        want = Counter()
        for r in sorted(own, key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0, r.size)):
            upto += r.size
            want[r.doc_id, r.size * (epochs + (target > epochs * size and upto - r.size / 2 <= target - epochs * size))] += 1
        assert Counter((r.doc_id, r.taken) for r in own) == want
