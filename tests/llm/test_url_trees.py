"""The trees of the URL filter: no label among the features, held-out URLs, hosts that no rule names."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factweave.llm import url_filter as U

NO_RULE = (("allow", "x.y", "/"),)


def plain_suffixes(rows, own, out_of_fold):
    """rows: (url, host, label, fold). Suffix share and mixed blocked share for a row of ``own``."""
    url, host, _, fold = own
    seen = [r for r in rows if not out_of_fold or r[3] != fold]
    mine = [r for r in seen if r[1].rsplit(".", 1)[-1] == host.rsplit(".", 1)[-1]]
    overall = sum(r[2] for r in seen) / len(seen)
    return len(mine) / len(seen), (sum(r[2] for r in mine) + U.PRIOR_ROWS * overall) / (len(mine) + U.PRIOR_ROWS)


@pytest.mark.parametrize("out_of_fold", [False, True])
def test_suffix_statistics_as_plain_version(spark, out_of_fold):
    rnd = random.Random(2)
    urls = [(f"http://a{i}.{rnd.choice(['com', 'net', 'org'])}/", float(rnd.random() < 0.4)) for i in range(120)] + [("http://hot.com/", 1.0)] * 60
    known = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(urls)], "id long, url string, label double").withColumn("host", U.host_of(F.col("url")))
    rows = [(r.url, r.host, r.label, r.fold) for r in known.withColumn("fold", U.fold_of(F.col("url"))).collect()]
    asked = known.withColumn("suffix", U.suffix_of(F.col("host")))
    if not out_of_fold:
        asked = asked.unionByName(spark.createDataFrame([(999, "http://new.xyz/", 0.0, "new.xyz", "xyz")], asked.schema))
    got = U.with_suffix_statistics(asked, U.suffix_counts(known), out_of_fold).collect()
    assert len(got) == asked.count()
    for r in got:
        want = plain_suffixes(rows, (r.url, r.host, r.label, r.fold if out_of_fold else None), out_of_fold)
        assert (r.suffix_share, r.suffix_blocked) == pytest.approx(want)


def auc(rows):
    good, bad = [r.block_score for r in rows if not r.label], [r.block_score for r in rows if r.label]
    return sum((b > g) + (b == g) / 2 for g in good for b in bad) / len(good) / len(bad)


def test_held_out_urls_and_unknown_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = U.host_of(F.col("url")), U.path_of(F.col("url"))
    ruled = pages.withColumn("found", U.longest_rule(host, path, U.RULES)).filter("found is not null")
    ruled = ruled.select("page_id", "url", (F.col("found.action") == "block").cast("double").alias("label"))
    fifth = F.pmod(F.hash("url"), F.lit(5)) == 0
    judged = U.judge_urls(ruled.filter(fifth).select("page_id", "url"), rules=NO_RULE, labelled=ruled.filter(~fifth).select("url", "label"))
    rows = judged.join(ruled.select("page_id", "label"), "page_id").collect()
    assert len(rows) > 150 and auc(rows) > 0.6
    unknown = defaultdict(int)
    for r in U.judge_urls(pages).filter("rule is null").collect():
        unknown[r.host.rsplit(".", 1)[-1], r.verdict] += 1
    assert unknown["org", "allow"] and unknown["org", "block"]


def test_labels_that_only_the_url_itself_tells_are_not_learnt(spark):
    """Labels by chance: what the trees say of other URLs must be chance too, even where each suffix has one row."""
    rnd = random.Random(5)
    make = lambda i: f"http://host{i % 7}.s{i}/page{rnd.randint(0, 99)}"
    rows = [(i, make(i), float(rnd.random() < 0.5)) for i in range(900)]
    known = spark.createDataFrame([(u, y) for _, u, y in rows[:600]], "url string, label double")
    pages = spark.createDataFrame(rows[600:], "page_id long, url string, label double")
    judged = U.judge_urls(pages.drop("label"), rules=NO_RULE, labelled=known).join(pages.select("page_id", "label"), "page_id").collect()
    assert 0.38 < auc(judged) < 0.62


def test_awkward_urls(spark):
    rows = [(1, "http://a.com/" + "x" * 300_000, "h", "p", 0.5), (1, None, "h", "p", 0.5), (None, "http://example.com/en/", None, None, None), (None, "http://example.com/en/", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, suffix_share double").withColumn("a.b", F.lit(1)).withColumn("label", F.lit("x"))
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in U.judge_urls(pages).collect()]
    assert len(got) == 4
    assert [g for g in got if g[0] == 1 and g[2]] == [(1, "a.com", "com/", "allow")]
    assert [g for g in got if g[0] is None] == [(None, "example.com", "example.com/en/", "block")] * 2
