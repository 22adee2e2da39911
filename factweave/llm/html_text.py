"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements with
their class and id. For each node of the merged tree, over the pages that have
it, two importances are computed from entropies: that of its presentation (how
varied the sequences of its children are) and that of its content (how evenly a
text of it is spread over the pages: what stands on all pages is not important).
What an element is called (element, role, words in class and id), whether it is
shown and whether it lies in the page's article are features of the page's own
nodes. Every page loses the branches of low importance and, whatever their
importance, those whose features speak against text for readers: parts that
differ from page to page (menus, adverts) can't be told from content by
entropy. Where a host's parts carry no telling names the tree alone decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .url_filter import host_of

# HTML's elements by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title svg math iframe object canvas audio video map select option datalist button textarea dialog".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Elements, roles and words in class or id that name what isn't part of an article.
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "alertdialog", "dialog", "toolbar"}
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer form gdpr header masthead menu menus modal nav navbar navigation newsletter "
    "notice notices pagination popup promo promoted promotion related reply replies respond responses sharing share "
    "sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
MAIN_ROLES = {"main", "article"}
#: A name that begins so says what its element goes with or lacks (has-sidebar, no-comments), not what it is.
ABOUT = {"has", "no", "not", "with", "without"}
#: With one of these, a name with "header" is that of a text's own heading (article-header).
OF_TEXT = {"article", "entry", "post", "story", "content", "chapter", "section"}
UNSEEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
NAME_PARTS = re.compile(r"[a-z]+")

#: Levels up to which a text is a feature of the nodes above it.
LEVELS = 32
#: Of a longer path a node keeps the hash, so that deep pages don't take quadratic space.
LONG_PATH = 2000


def names_furniture(names: str) -> bool:
    """Whether one of the names in a class or id names what isn't part of an article."""
    for one in names.lower().split():
        parts = NAME_PARTS.findall(one)
        if not parts or parts[0] in ABOUT:
            continue
        found = WORDS.intersection(parts)
        if found and not (found == {"header"} and OF_TEXT.intersection(parts)):
            return True
    return False


@lru_cache(maxsize=8192)
def features_of(tag: str, classes: str, ident: str, role: str) -> tuple[str, bool, bool]:
    """A node's name, whether it names furniture, and whether it is an article. Digits in names often count items; they don't make another node."""
    name = " ".join([tag, *(re.sub(r"\d+", "0", v) for v in (classes, ident) if v)])
    named = tag not in ("html", "body") and (names_furniture(classes) or names_furniture(ident))
    return name, tag in FURNITURE or role in ROLES or named, tag in ("article", "main") or role in MAIN_ROLES


class Node:
    __slots__ = ("tag", "name", "path", "children", "furniture", "main", "shown")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag = tag
        self.name, self.furniture, self.main = features_of(tag, attrs.get("class") or "", attrs.get("id") or "", (attrs.get("role") or "").lower())
        above = parent.path if parent and parent.tag != "#" else ""
        if len(above) > LONG_PATH:
            above = f"{short_hash(above):x}"
        self.path = f"{above}>{self.name}" if above else self.name
        self.children: list[Node | str] = []
        style = attrs.get("style")
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(style and UNSEEN.search(style))
        self.shown = tag not in SILENT and not hidden


class TreeBuilder(HTMLParser):
    """The page's tree; missing end tags are supplied as browsers do, as far as text blocks depend on it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", {}, None)
        self.open = [self.root]
        self.tags: Counter = Counter()

    def close_from(self, i: int) -> None:
        for n in self.open[i:]:
            self.tags[n.tag] -= 1
        del self.open[i:]

    def close_if(self, tags: set[str], within: set[str]) -> bool:
        """Closes the innermost open one of the tags, unless an element of ``within`` is further in."""
        if not any(self.tags[t] for t in tags):
            return False
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.close_from(i)
                return True
            if self.open[i].tag in within:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self.close_if({"p"}, {"table", "td", "th", "li", "div", "article", "section", "body", "button", "object", "caption"})
        while tag in SAME and self.close_if(SAME[tag], SCOPE[tag]):
            pass
        if tag in ("html", "body") and self.tags[tag]:
            return
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.tags[tag]:
            return
        i = len(self.open) - 1
        while self.open[i].tag != tag:
            i -= 1
        self.close_from(i)

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def parse(html: str | None) -> Node:
    builder = TreeBuilder()
    try:
        builder.feed(html or "")
        if re.match("<[A-Za-z/!?]", builder.rawdata):  # a tag or comment that the page's end cuts off
            builder.rawdata = ""
        builder.close()
    except AssertionError:  # a broken declaration: what was read until there counts, and the rest as text without tags
        builder.handle_data(unescape(re.sub(r"<[^>]*>", " ", builder.rawdata)))
    return builder.root


def short_hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def own_text(node: Node) -> str:
    """The text of a node with that of the inline elements in it, white space as one space."""
    parts: list[str] = []
    stack = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif c.tag in INLINE and c.shown:
            stack.extend(reversed(c.children))
    return " ".join("".join(parts).split())


def inner_blocks(node: Node) -> list[Node]:
    """The nearest shown block elements below a node, through inline ones."""
    out = []
    stack = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str) or not c.shown or c.tag == "br":
            continue
        if c.tag in INLINE:
            stack.extend(reversed(c.children))
        else:
            out.append(c)
    return out


def blocks(root: Node) -> list[tuple[Node, int, list[Node]]]:
    """The root and all shown block elements, each after the one it lies in: the element, that one's place, its inner blocks."""
    out = [(root, -1, inner_blocks(root))]
    at = 0
    while at < len(out):
        for c in out[at][2]:
            out.append((c, at, inner_blocks(c)))
        at += 1
    return out


PRESENTATION, CONTENT = 0, 1


def site_features(host: str, html: str | None) -> list[tuple[int, int, int]]:
    """For each node of a page: its key, the kind of a feature, and that feature; each once a page.

    The children's sequence is the feature of presentation; the texts, of the
    node and of up to LEVELS levels below it, are those of content.
    """
    found: set[tuple[int, int, int]] = set()
    tree = blocks(parse(html))
    keys = [short_hash(host, n.path) for n, _, _ in tree]
    for i, (node, _, inner) in enumerate(tree):
        if node.tag != "#":
            found.add((keys[i], PRESENTATION, short_hash(",".join(dict.fromkeys(c.name for c in inner)))))
            if text := own_text(node):
                feature, at = short_hash(text), i
                for _ in range(LEVELS + 1):
                    if at <= 0:
                        break
                    found.add((keys[at], CONTENT, feature))
                    at = tree[at][1]
    return list(found)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        hosts: dict[int, str] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            for feature in site_features(host, html.as_py()):
                seen[feature] += 1
                hosts[feature[0]] = host
        keys = list(seen)
        columns = [
            pa.array([hosts[k[0]] for k in keys], pa.string()),
            pa.array([k[0] for k in keys], pa.int64()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.int64()),
            pa.array([seen[k] for k in keys], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "node", "kind", "feature", "n"])


def style_tree(pages: DataFrame, threshold: float = 0.55) -> DataFrame:
    """pages has host and html. The merged trees' nodes: host, node, pages, presentation, content, importance.

    presentation is the entropy of the children's sequences, to the base of the
    number of pages. content is 1 minus the mean, over the texts' occurrences,
    of the entropy with which a text is spread over the pages (log of its pages
    to the base of all). importance is their larger one, brought nearer to 1 by
    1 / pages of the difference: the fewer pages have a node, the less there is
    to compare, and a node of one page has importance 1. Equal features are
    summed before they meet; one host is never in one task.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("host", "html").mapInArrow(_feature_batches, "host string, node long, kind int, feature long, n long")
    features = rows.groupBy("node", "kind", "feature").agg(F.min("host").alias("host"), F.sum("n").alias("n"))
    n, log = F.col("n"), F.col("n") * F.log("n")
    nodes = features.groupBy("node").agg(
        F.min("host").alias("host"),
        F.sum(F.when(F.col("kind") == PRESENTATION, n).otherwise(0)).alias("pages"),
        F.sum(F.when(F.col("kind") == PRESENTATION, log).otherwise(0.0)).alias("shapes"),
        F.sum(F.when(F.col("kind") == CONTENT, n).otherwise(0)).alias("texts"),
        F.sum(F.when(F.col("kind") == CONTENT, log).otherwise(0.0)).alias("spread"),
    )
    base = F.log("pages")
    presentation = F.when(F.col("pages") > 1, (base - F.col("shapes") / F.col("pages")) / base).otherwise(1.0)
    content = F.when((F.col("pages") > 1) & (F.col("texts") > 0), 1 - F.col("spread") / F.col("texts") / base).otherwise(1.0)
    nodes = nodes.withColumn("presentation", presentation).withColumn("content", content)
    larger = F.greatest("presentation", "content")
    return nodes.withColumn("importance", larger + (1 - larger) / F.col("pages")).withColumn("noise", F.col("importance") < threshold).drop("shapes", "spread")


def main_nodes(root: Node) -> set[int]:
    """The identities of the outermost articles that are in no furniture, else of main elements, else of the whole page."""
    articles, mains = [], []
    stack = [root]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str) or not c.shown or c.furniture and not c.main:
                continue
            if c.main and not c.furniture:
                (mains if c.tag == "main" else articles).append(c)
                if c.tag != "main":
                    continue
            stack.append(c)
    return {id(n) for n in articles or mains or [root]}


def low_branches(root: Node, host: str, noise) -> set[int]:
    """The identities of block elements that are of low importance with all block elements below them."""
    if not noise:
        return set()
    tree = blocks(root)
    low = [n.tag != "#" and short_hash(host, n.path) in noise for n, _, _ in tree]
    for i in range(len(tree) - 1, 0, -1):  # what lies in an element comes after it
        if not low[i] and tree[i][1] >= 0:
            low[tree[i][1]] = False
    return {id(tree[i][0]) for i in range(len(tree)) if low[i]}


def text_blocks(root: Node, mains: set[int], low: set[int]) -> list[str]:
    """The blocks in page order that are in ``mains`` and in no furniture and no branch of low importance."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    # An element, or the end of a block (None); and whether it lies in a main element.
    stack: list[tuple[Node | str | None, bool]] = [(root, id(root) in mains)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                run.append(node)
        elif node.tag == "br":
            run.append(" ")
        else:
            inside = inside or id(node) in mains
            inline = node.tag in INLINE
            if not inline:
                flush()
            if not node.shown or node.furniture and id(node) not in mains or not inline and id(node) in low:
                continue
            if not inline:
                stack.append((None, inside))
            stack.extend((c, inside) for c in reversed(node.children))
    flush()
    return out


def extract(html: str | None, host: str, noise) -> str:
    """The page's main text.

    noise: keys of the host's nodes of low importance. Branches whose own
    features are against them go as well: those that name themselves as
    furniture, those that aren't shown, and those outside the article where
    there is one. If no text of the page is important (it is the same as the
    host's other pages), entropy can't tell, and these features alone decide.
    """
    root = parse(html)
    mains = main_nodes(root)
    low = low_branches(root, host, noise)
    kept = text_blocks(root, mains, low)
    if not kept and low:
        kept = text_blocks(root, mains, set())
    return "\n".join(kept)


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.55
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives an empty text. Pages whose URL is null or has no
    host are one site. Repeated rows get equal texts; columns other than the three are not read. A host's
    template (its nodes of low importance) goes to the tasks that have its
    pages by a join on the host, which Spark broadcasts if it is small and else
    splits where a host is large.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    nodes = style_tree(rows, threshold)
    noise = nodes.filter("noise").groupBy("host").agg(F.collect_set("node").alias("noise"))
    noise = materialize(noise.withColumnRenamed("host", "_host"), "site-templates")
    joined = rows.join(noise, rows["host"] == noise["_host"], "left").select("page_id", "url", "host", "html", "noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extract(html.as_py(), host, set(low or ()))
                for host, html, low in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist())
            ]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
