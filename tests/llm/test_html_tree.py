"""Importance in the merged tree against a plain version, and pages that names alone judge wrongly."""

import math
import random
from collections import Counter, defaultdict

import pytest

from factweave.llm import html_text

STORY = "<p>The whole story."


@pytest.mark.parametrize(
    "html,want",
    [
        (f'<div class="content has-sidebar">{STORY}</div>', "The whole story."),
        (f'<div id="page" class="site no-comments">{STORY}</div>', "The whole story."),
        (f'<article class="post has-sidebar">{STORY}</article><div>outside</div>', "The whole story."),
        ('<article><div class="article-header"><h1>Title</h1></div><p>Text</article>', "Title\nText"),
        (f'<div class="post-comments"><p>Nice</div><div>{STORY}</div>', "The whole story."),
        (f'<p style="color:red; display: none">secret<p>{STORY}<span style="visibility:hidden">no</span></p>', "The whole story."),
        (f"<div hidden>secret</div>{STORY}", "The whole story."),
        ("<div>" * 400 + "<script>var leak=1;</script><nav>menu leak</nav><p>deep text" + "</div>" * 400, "deep text"),
        ("<i>" * 20_000 + "<script>leak</script>x", "x"),
        ("<div>" * 20_000 + "x" + "</b>" * 20_000, "x"),
    ],
)
def test_names_say_what_an_element_is(html, want):
    assert html_text.extract(html, "h", set()) == want


def site(n=40, seed=1):
    """Pages without article, main or any telling name: only a comparison of the host's pages finds the template."""
    rnd = random.Random(seed)
    words = lambda k: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 7) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        want[i] = "\n".join([words(6), words(40)])
        title, text = want[i].split("\n")
        html = f"<div class=u><ul><li><a href=/>Home</a><li><a href=/p>Prices</a></ul></div><div class=v><h2>{title}</h2><p>{text}</p><p class=k>Read on, it is free</p></div><div class=w>All rights by Us {2000 + i % 2}</div>"
        rows.append((i, f"http://plain.org/{i}", html, None))
    return rows, want


def test_the_tree_decides(spark):
    rows, want = site()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, noise string").repartition(3)
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == want
    off = {i: html_text.extract(h, "plain.org", set()) for i, _, h, _ in rows}
    assert all(off[i] != want[i] and "Home" in off[i] and "All rights" in off[i] for i in want)


def plain_tree(pages):
    """Importance of each path of one host, straight from its definition."""
    shapes, texts, having = defaultdict(Counter), defaultdict(Counter), Counter()

    def walk(node, path):
        own, below = html_text.own_text(node), []
        inner = html_text.inner_blocks(node)
        for c in inner:
            below += walk(c, [*path, c.name])
        below += [own] if own else []
        if path:
            seen[">".join(path)].append((tuple(dict.fromkeys(c.name for c in inner)), below))
        return below

    for html in pages:
        seen = defaultdict(list)
        walk(html_text.parse(html), [])
        for path, found in seen.items():
            having[path] += 1
            for shape in {s for s, _ in found}:
                shapes[path][shape] += 1
            for text in {t for _, ts in found for t in ts}:
                texts[path][text] += 1
    out = {}
    for path in shapes:
        m = sum(shapes[path].values())
        if m < 2:
            out[path] = 1.0
            continue
        presentation = -sum(n / m * math.log(n / m, m) for n in shapes[path].values())
        total = sum(texts[path].values())
        content = 1 - sum(n * math.log(n, m) for n in texts[path].values()) / total if total else 1.0
        larger = max(presentation, content)
        out[path] = larger + (1 - larger) / m
    return out


def test_importance_against_a_plain_version(spark):
    rnd = random.Random(8)
    pages = [h for _, _, h, _ in site(12, 3)[0]]
    pages += [f"<div class=v><p>{rnd.choice(['same', 'other', str(i)])}<p>{i % 3}</div>" + "<ul><li>x</ul>" * (i % 2) for i in range(15)] + ["", "<p>", "<div><div>once"]
    df = spark.createDataFrame([("one", h) for h in pages], "host string, html string").repartition(4)
    got = {r.node: r.importance for r in html_text.style_tree(df).collect()}
    want = {html_text.short_hash("one", p): x for p, x in plain_tree(pages).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_awkward_pages(spark):
    long_text = "word " * 200_000
    rows = [(1, "http://a.org/", f"<p>{long_text}", "x"), (1, "http://a.org/", f"<p>{long_text}", "x"), (None, None, None, None), (2, "http://a.org/b", "", "y"), (3, "u", "<p>&eacute;&#x41;", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumnRenamed("host", "_host")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.main_text(pages).collect())
    text = long_text.strip()
    assert got == Counter({(1, text, len(text)): 2, (None, "", 0): 1, (2, "", 0): 1, (3, "éA", 2): 1})
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_long_paths_keep_nodes_apart():
    one = html_text.site_features("h", "<div class=abcdefghij>" * 500 + "<p>x")
    two = html_text.site_features("h", "<div class=abcdefghij>" * 501 + "<p>x")
    nodes = {k for k, _, _ in one}
    assert len(nodes) == 501 and len(nodes & {k for k, _, _ in two}) == 500
