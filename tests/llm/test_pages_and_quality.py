"""HTML extraction, URL filters and quality resampling."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from factweave.llm import html_text, quality, url_filter

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="home"><header><h1>Site name</h1><nav><ul><li><a href=/>Home</a></ul></nav></header>
<div class="cookie-notice">We use cookies</div><!-- ad --><aside>Side</aside>
<main><article><h1>A&amp;B &#233;cole</h1><p>One <b>bold
 word</b><br>more<p>Two &lt;tag&gt;<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table>
<form><input><button>Go</button>Join</form><div class="ad">Buy</div><pre>  a
  b </pre><blockquote>Quote</blockquote></article>
<section id="comments"><article><p>Nice post</p></article></section></main>
<footer>&copy; us</footer></body></html>"""
WANT = "A&B école\nOne bold word more\nTwo <tag>\nx\ny\nc1\nc2\na b\nQuote"


def test_extract_one_page():
    assert html_text.extract(PAGE, "h", set()) == WANT


@pytest.mark.parametrize("html", [None, "", "<", "<p", "plain", "<p>a<p>b", "<![CDATA[x]]><p>y", "<!x <p>z", "</p></div>", "<b>" * 3000 + "deep"])
def test_extract_odd_pages(html):
    text = html_text.extract(html, "", set())
    assert "<" not in text or html == "<"
    if html in ("<p>a<p>b", "plain"):
        assert text == {"<p>a<p>b": "a\nb", "plain": "plain"}[html]


def test_template_branches_go(spark):
    rnd = random.Random(4)
    words = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(30))
    rows, want = [], {}
    for i in range(60):
        text = words()
        want[i] = text
        html = f"<body><div class=x><p>Welcome to our site<p>{['Top', 'Best'][i % 2]}</div><div class=y><p>{text}</div><div class=z>All rights</div></body>"
        rows.append((i, f"http://site.org/{i}", html, "extra"))
    rows += [(60, "http://other.org/", "<div>only page</div>", None), (61, None, None, None), (62, "no scheme", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == want | {60: "only page", 61: "", 62: ""}


def test_equal_pages_keep_their_article(spark):
    rows = [(i, f"http://copies.org/{i}", "<body><div class=t>Top</div><article><p>The same article everywhere</article></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_text.main_text(pages).collect()} == {"The same article everywhere"}


def test_importance_from_entropy(spark):
    rows = [("h", f"<body><p>{i}</p><div>same</div></body>") for i in range(8)]
    nodes = {r.node: r for r in html_text.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    of = lambda path: nodes[html_text.short_hash("h", path)]
    assert of("body>p").content == pytest.approx(1) and not of("body>p").noise
    assert of("body>div").content == pytest.approx(0) and of("body>div").noise
    assert of("body").content == pytest.approx(0.5)


def test_extract_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = html_text.main_text(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.n_chars == len(r.text) > 0 and "example." not in r.text.split("\n")[-1]


def plain_judgement(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for action, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return host, path, best


ODD_URLS = [None, "", "no-scheme", "http://", "http://COM/", "http://com", "HTTP://Www.Example.COM/en/x?a=/es/#y", "http://example.com/en", "http://notexample.com/en/",
            "ftp://a.net/es/", "http://net/fr/", "x://y://example.com/en/", "http://é.net/es/é", "http://a.b.example.com/en/?q", "//example.com/en/", "http://h?://example.com/en/"]


def test_url_rules(spark):
    given = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    urls = given + ODD_URLS + ODD_URLS[:3]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, best = plain_judgement(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1])
        assert got[i].verdict == (best[0] if best else "block" if got[i].block_score > 0.5 else "allow")


def test_url_trees_learn_labels(spark):
    rnd = random.Random(9)
    def make(bad):
        host = "".join(rnd.choice("0123456789-" if bad else "abcdefgh") for _ in range(12)) + rnd.choice([".org", ".info"])
        return f"http://{host}/{'?a=1&b=2&c=3' if bad else 'news/today'}"
    rows = [(i, make(i % 2 == 1), float(i % 2)) for i in range(1200)]
    known = spark.createDataFrame([(u, y) for _, u, y in rows[:800]], "url string, label double")
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows[800:]], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules=(("allow", "x.y", "/"),), labelled=known).collect()}
    right = sum(got[i] == ("block" if y else "allow") for i, _, y in rows[800:])
    assert right >= 390


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.judge_urls(pages).first().verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.resample(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
    assert len(good) > 20 and len(bad) > 3 and auc > 0.9


def test_quality_weights_and_cut(spark):
    rows = [(i, ["good word here", "bad!! thing"][i % 2], "x") for i in range(500)] + [(None, None, "y"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 500, 3)] + [(7, None)], "doc_id long, quality int")
    got = quality.resample(docs, labels, share=0.3).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (-r.key, -(r.doc_id if r.doc_id is not None else -1)))
    assert [r.kept for r in order] == [True] * round(0.3 * len(rows)) + [False] * (len(rows) - round(0.3 * len(rows)))
    assert {r.log_weight for r in got if r.n_grams == 0} == {0.0}
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).filter("kept").count() == len(rows)


def test_largest_counts_ties(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 100).cast("double").alias("key"))
    kept = [r.doc_id for r in quality.largest(df, 0.25).filter("kept").collect()]
    assert sorted(kept) == [*range(750, 1000)]


def test_url_labels_of_a_rare_kind_and_a_frequent_url(spark):
    good = [(f"http://site{i}.org/news/today", 0.0) for i in range(4000)] + [("http://one.org/", 0.0)] * 2000
    known = spark.createDataFrame([*good, ("http://0-1-2-3.bad/?a=1&b=2", 1.0), ("http://4-5-6-7.bad/?a=1&b=2", 1.0)], "url string, label double")
    rows = known.withColumn("id", F.monotonically_increasing_id())
    some = url_filter.label_sample(rows, {0.0: 6000, 1.0: 2}, 300).collect()
    assert sum(r.label for r in some) == 2 and 200 < len(some) < 400
    assert 50 < sum(r.url == "http://one.org/" for r in some) < 150
    pages = spark.createDataFrame([(1, "http://8-9-8-9.bad/?a=1&b=2"), (2, "http://site77.org/news/today")], "page_id long, url string")
    judged = url_filter.judge_urls(pages, rules=(("allow", "x.y", "/"),), labelled=known, sample=300).collect()
    assert {r.page_id: r.verdict for r in judged} == {1: "block", 2: "allow"}
