"""The pipeline against a plain version of its five stages, and its stages on awkward rows."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import tiktoken
from factweave.llm import bpe
from test_core_operators import AWKWARD, SCHEMA, low, plain_targets
from test_similar import plain_groups

SF = "/root/testdata/sf0.001"


def plain_mix(docs, quality):
    """docs: id, text, source. How often each is taken."""
    words = {i: len(t.encode().split()) for i, (t, _) in docs.items()}
    sizes = Counter()
    for i, (_, source) in docs.items():
        sizes[source] += words[i]
    goals, taken = plain_targets(sizes, (3, 1, 2), 1.5, 2.0), {}
    keys = {}
    for i in docs:
        u = (int(hashlib.md5(f"0|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        keys[i] = -math.log(u) / quality.get(i, 1.0)
    for source in sizes:
        own = sorted((i for i in docs if docs[i][1] == source), key=keys.get)
        epochs, upto = int(goals[source] // sizes[source]) if sizes[source] else 0, 0
        rest = goals[source] - epochs * sizes[source]
        for i in own:
            upto += words[i]
            taken[i] = epochs + (rest > 0 and upto - words[i] / 2 <= rest) if words[i] else 0
    return taken


def test_pipeline_as_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = {r.doc_id: (r.text, r.source) for r in rows if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for i in sorted(kept):
        best[low(kept[i][0])] = i
    kept = {i: kept[i] for i in best.values()}
    groups = plain_groups({i: t for i, (t, _) in kept.items()})
    kept = {i: kept[i] for i in kept if groups[i] == i}
    times = plain_mix(kept, {r.doc_id: 2.0 if r.quality else 0.5 for r in labels})
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter({(i, tuple(known.encode_ordinary(kept[i][0]))): n for i, n in times.items() if n})
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and all(r.n_tokens == len(r.ids) for r in corpus_pipeline.run(spark, SF).take(3))


def test_stages_on_awkward_and_no_rows(spark):
    docs = spark.createDataFrame([r for r in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert SCHEMA
    for start in (docs, docs.limit(0), docs.withColumn("fp", docs["doc_id"])):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == now.columns, name
            rows = out.collect()
            now = spark.createDataFrame(rows, out.schema)
        ids = defaultdict(int)
        for r in rows:
            ids[r.doc_id] += 1
        assert all(n <= 2 for n in ids.values())
        assert bool(rows) == (start.count() > 0)


def test_stages_judge_rows_that_share_an_id_one_by_one(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    texts = [(1, words(0)), (1, words(1)), (1, None), (2, words(2)), (2, words(2)), (None, words(3)), (None, words(4)), (None, words(0)), (3, words(5))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = Counter([(1, words(0)), (1, words(1)), (2, words(2)), (None, words(3)), (None, words(4)), (3, words(5))])
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, now, SF)
        if name == "language_id":
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(x for x in texts if x[1])
        else:
            assert Counter((r.doc_id, r.text) for r in out.collect()) == want, name
        now = spark.createDataFrame(out.collect(), out.schema)
    # near-dedup alone must tell the rows apart too, and the mix takes each row on its own
    near = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs.filter("text is not null"), SF)
    assert Counter((r.doc_id, r.text) for r in near.collect()) == want
    mixed = dict(corpus_pipeline.STAGES)["source_mixing"](spark, now, SF)
    assert {r.text for r in mixed.collect()} == {t for _, t in want}
    assert mixed.columns == docs.columns
