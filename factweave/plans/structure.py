"""Structure of documents: items, sections, zones, chunks, units, regions, pages and slides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..sources import storage
from ..sources.items import ITEMS_SQL, items
from ..sources.tables import read
from .registry import query

OPEN_SQL = f"""{ITEMS_SQL}, o AS (SELECT *, max(pos) FILTER (WHERE level = 1) OVER w AS h1, max(pos) FILTER (WHERE level = 2) OVER w AS h2, max(pos) FILTER (WHERE level = 3) OVER w AS h3 FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


def open_headings(spark, sf_dir):
    """Each item with the position of the last heading of each level until it."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return items(spark, sf_dir).select("*", *[F.max(F.when(F.col("level") == k, F.col("pos"))).over(w).alias(f"h{k}") for k in (1, 2, 3)])


@query("section_tree", [171], f"""WITH {OPEN_SQL} SELECT doc_id, pos::BIGINT AS pos, kind, concat_ws('>', h1::VARCHAR, CASE WHEN h2 > coalesce(h1, -1) THEN h2 END::VARCHAR, CASE WHEN h3 > greatest(coalesce(h1, -1), coalesce(h2, -1)) THEN h3 END::VARCHAR) AS path,
  greatest(coalesce(h1, -1), coalesce(h2, -1), coalesce(h3, -1))::BIGINT AS section FROM o""")
def section_tree(spark, sf_dir):
    """The open headings above each item, as a stack would hold them: a heading closes those of its level and below."""
    at = lambda k: F.coalesce(f"h{k}", F.lit(-1))
    open2, open3 = F.when(at(2) > at(1), F.col("h2")), F.when(at(3) > F.greatest(at(1), at(2)), F.col("h3"))
    path = F.concat_ws(">", *[c.cast("string") for c in (F.col("h1"), open2, open3)])
    return open_headings(spark, sf_dir).select("doc_id", "pos", "kind", path.alias("path"), F.greatest(at(1), at(2), at(3)).alias("section"))


@query("section_type_profiles", [172], f"""WITH {OPEN_SQL}, s AS (SELECT doc_id, greatest(coalesce(h1, -1), coalesce(h2, -1), coalesce(h3, -1)) AS section, kind FROM o)
SELECT doc_id, section::BIGINT AS section, count(*)::BIGINT AS items, round(avg(CASE WHEN kind = 'table' THEN 1.0 ELSE 0 END), 6) AS tables, round(avg(CASE WHEN kind = 'code' THEN 1.0 ELSE 0 END), 6) AS code, round(avg(CASE WHEN kind = 'paragraph' THEN 1.0 ELSE 0 END), 6) AS paragraphs FROM s GROUP BY ALL""")
def section_type_profiles(spark, sf_dir):
    """What a section is made of: the shares of its items' kinds."""
    section = F.greatest(*[F.coalesce(f"h{k}", F.lit(-1)) for k in (1, 2, 3)])
    share = lambda kind: F.round(F.avg((F.col("kind") == kind).cast("double")), 6)
    own = open_headings(spark, sf_dir).groupBy("doc_id", section.alias("section"))
    return own.agg(F.count("*").alias("items"), share("table").alias("tables"), share("code").alias("code"), share("paragraph").alias("paragraphs"))


@query("type_aware_chunks", [173])
def type_aware_chunks(spark, sf_dir):
    return C.type_aware_chunks(items(spark, sf_dir))


@query("page_zones", [177], """WITH l AS (SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, trim(unnest(m)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS m FROM documents)),
s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE length(line) >= 3),
z AS (SELECT *, least(5, n // 3 + 1) AS t0, least(5, n // 3 + 1) AS b0 FROM s), y AS (SELECT *, CASE WHEN n > 2 AND n - t0 - b0 < 1 THEN greatest(1, n // 3) ELSE t0 END AS t FROM z)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN i < t THEN 'TOP' WHEN i >= n - t THEN 'BOTTOM' ELSE 'MAIN' END AS zone FROM y""")
def page_zones(spark, sf_dir):
    """Lines at the top, in the middle and at the bottom: up to five at either end, and one in the middle where there are three."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.length(F.trim("line")) >= 3)
    own = Window.partitionBy("doc_id")
    n, i = F.count("*").over(own), F.row_number().over(own.orderBy("pos")) - 1
    placed = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), i.alias("i"), n.alias("n"))
    third = F.floor(F.col("n") / 3)
    most = F.least(F.lit(5), third + 1)
    edge = F.when((F.col("n") > 2) & (F.col("n") - 2 * most < 1), F.greatest(F.lit(1), third)).otherwise(most)
    return placed.select("doc_id", "pos", F.when(F.col("i") < edge, "TOP").when(F.col("i") >= F.col("n") - edge, "BOTTOM").otherwise("MAIN").alias("zone"))


@query("linearised_documents", [179], f"""WITH {ITEMS_SQL} SELECT doc_id, sha256(string_agg('[' || upper(kind) || ' ' || pos || '] ' || line, chr(10) ORDER BY pos)) AS marked_sha256, sha256(string_agg(line, chr(10) ORDER BY pos)) AS plain_sha256, count(*)::BIGINT AS items FROM items GROUP BY doc_id""")
def linearised_documents(spark, sf_dir):
    """Items joined to one marked text, and the marks stripped from it again."""
    mark = F.concat(F.lit("["), F.upper("kind"), F.lit(" "), F.col("pos").cast("string"), F.lit("] "), F.col("line"))
    lists = items(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", mark.alias("line")))).alias("lines"))
    marked = lists.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("marked"), F.size("lines").cast("long").alias("items"))
    plain = F.regexp_replace("marked", r"(?m)^\[(HEADING|PARAGRAPH|TABLE|CODE) [0-9]+\] ", "")
    return marked.select("doc_id", F.sha2("marked", 256).alias("marked_sha256"), F.sha2(plain, 256).alias("plain_sha256"), "items")


@query("assertion_units", [170], rf"""WITH {ITEMS_SQL}, u AS (SELECT doc_id, pos, 'row' AS kind, 1 AS unit, line AS text FROM items WHERE kind = 'table' UNION ALL
  SELECT doc_id, pos, 'sentence', generate_subscripts(m, 1), trim(unnest(m)) FROM (SELECT doc_id, pos, regexp_extract_all(line, '[^.!?]+[.!?]?') AS m FROM items WHERE kind <> 'table'))
SELECT doc_id, pos::BIGINT AS pos, kind, unit::BIGINT AS unit, text FROM u WHERE kind = 'row' OR length(text) BETWEEN 30 AND 500""")
def assertion_units(spark, sf_dir):
    """An item's sentences of 30 to 500 characters, numbered in the item; a table row is one unit."""
    own = items(spark, sf_dir)
    rows = own.filter("kind = 'table'").select("doc_id", "pos", F.lit("row").alias("kind"), F.lit(1).cast("long").alias("unit"), F.col("line").alias("text"))
    parts = own.filter("kind != 'table'").select("doc_id", "pos", F.posexplode(F.regexp_extract_all("line", F.lit("[^.!?]+[.!?]?"), F.lit(0))).alias("i", "text"))
    parts = parts.select("doc_id", "pos", F.lit("sentence").alias("kind"), (F.col("i") + 1).cast("long").alias("unit"), F.trim("text").alias("text"))
    return rows.unionByName(parts.filter(F.length("text").between(30, 500)))


@query("layout_regions", [178], f"""WITH {ITEMS_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS island FROM items)
SELECT doc_id, kind, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, count(*)::BIGINT AS items, kind = 'table' AND max(pos) - min(pos) + 1 > count(*) AS cut FROM g GROUP BY doc_id, kind, island""")
def layout_regions(spark, sf_dir):
    """Runs of items of one kind; a table whose rows have a gap between them is marked as cut."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    island = F.row_number().over(own) - F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos"))
    runs = items(spark, sf_dir).withColumn("island", island).groupBy("doc_id", "kind", "island")
    made = runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("items")).drop("island")
    return made.withColumn("cut", F.expr("kind = 'table' and last - first + 1 > items"))


@query("vision_gating", [181], f"""WITH {ITEMS_SQL}, s AS (SELECT doc_id, avg(CASE WHEN kind = 'table' THEN 1.0 ELSE 0 END) AS t, avg(CASE WHEN kind = 'code' THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN kind = 'heading' THEN 1.0 ELSE 0 END) AS f, least(stddev_pop(length(line)) / avg(length(line)), 1) AS d, avg(CASE WHEN regexp_matches(line, '[^A-Za-z ]{{4,}}') THEN 1.0 ELSE 0 END) AS x FROM items GROUP BY doc_id),
v AS (SELECT doc_id, round((0.3 * c + 0.3 * t + 0.15 * d + 0.15 * f + 0.1 * x)::DOUBLE, 6) AS need FROM s) SELECT doc_id, need, CASE WHEN need >= 0.6 THEN 'required' WHEN need >= 0.4 THEN 'recommended' ELSE 'none' END AS gate FROM v""")
def vision_gating(spark, sf_dir):
    """Whether a document's layout needs a look at the page image: five signals, weighted."""
    share = lambda cond: F.avg(cond.cast("double"))
    kind = lambda k: share(F.col("kind") == k)
    spread = F.least(F.stddev_pop(F.length("line")) / F.avg(F.length("line")), F.lit(1.0))
    odd = share(F.col("line").rlike("[^A-Za-z ]{4,}"))
    need = F.round(0.3 * kind("code") + 0.3 * kind("table") + 0.15 * spread + 0.15 * kind("heading") + 0.1 * odd, 6)
    own = items(spark, sf_dir).groupBy("doc_id").agg(need.alias("need"))
    return own.withColumn("gate", F.when(F.col("need") >= 0.6, "required").when(F.col("need") >= 0.4, "recommended").otherwise("none"))


@query("concept_density", [183], r"""WITH m AS (SELECT doc_id, length(text) AS n, greatest(len(regexp_extract_all(text, '[^ \n]+')), 1) AS words, len(regexp_extract_all(text, '\b[A-Z]{2,6}\b')) AS acronyms, len(regexp_extract_all(text, '[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+|[a-z]+[A-Z][a-z]+')) AS technical, len(regexp_extract_all(text, '[A-Za-z]{11,}')) AS rare FROM documents),
s AS (SELECT doc_id, n, round((0.35 * least(acronyms * 20.0 / words, 1) + 0.35 * least(technical / 10.0, 1) + 0.3 * least(rare * 5.0 / words, 1))::DOUBLE, 6) AS score FROM m)
SELECT doc_id, CASE WHEN n < 200 THEN 0.5 ELSE score END::DOUBLE AS density, CASE WHEN n < 200 THEN 'hybrid' WHEN score >= 0.55 THEN 'model_first' WHEN score >= 0.25 THEN 'hybrid' ELSE 'rules' END AS method FROM s""")
def concept_density(spark, sf_dir):
    """Which way of extraction suits a text: by acronyms, technical patterns and long words; short texts can't tell."""
    text = F.col("text")
    words = F.greatest(T.count_matches(text, "[^ \n]+"), F.lit(1))
    acronyms = T.count_matches(text, r"(?<![A-Za-z0-9_])[A-Z]{2,6}(?![A-Za-z0-9_])")
    technical = T.count_matches(text, "[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+|[a-z]+[A-Z][a-z]+")
    rare = T.count_matches(text, "[A-Za-z]{11,}")
    cap = lambda c: F.least(c, F.lit(1.0))
    score = F.round(0.35 * cap(acronyms * 20.0 / words) + 0.35 * cap(technical / 10.0) + 0.3 * cap(rare * 5.0 / words), 6)
    own = read(spark, sf_dir, "documents").select("doc_id", (F.length(text) < 200).alias("short"), score.alias("score"))
    method = F.when(F.col("short"), "hybrid").when(F.col("score") >= 0.55, "model_first").when(F.col("score") >= 0.25, "hybrid").otherwise("rules")
    return own.select("doc_id", F.when(F.col("short"), 0.5).otherwise(F.col("score")).alias("density"), method.alias("method"))


@query("document_pages", [4], f"""WITH {ITEMS_SQL}, p AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS page FROM items)
SELECT doc_id, page::BIGINT AS page, count(*)::BIGINT AS lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_sha256 FROM p GROUP BY doc_id, page""")
def document_pages(spark, sf_dir):
    """A document's text in pages: each heading of the first level begins one; what comes before is page 0."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    paged = items(spark, sf_dir).withColumn("page", F.sum((F.col("level") == 1).cast("long")).over(w))
    lists = paged.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return lists.select("doc_id", "page", F.size("lines").cast("long").alias("lines"), F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("text_sha256"))


SLIDES_SQL = r"""slides AS (SELECT page_id, generate_subscripts(m, 1) AS pos, unnest(m) AS item FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li)>[^<]*') AS m FROM pages))"""


def slide_items(spark, sf_dir):
    """page_id, pos, item: title, paragraphs and bullets of a page as they stand in its markup."""
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|p|li)>[^<]*"), F.lit(0))).alias("pos", "item"))


@query("slide_texts", [5, 6], rf"""WITH {SLIDES_SQL}, t AS (SELECT page_id, pos, CASE WHEN starts_with(item, '<h1>') THEN '# ' || substr(item, 5) WHEN starts_with(item, '<li>') THEN '- ' || substr(item, 5) ELSE substr(item, 4) END AS line FROM slides)
SELECT page_id, count(*)::BIGINT AS items, count(*) FILTER (WHERE starts_with(line, '- '))::BIGINT AS bullets, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_sha256 FROM t GROUP BY page_id""")
def slide_texts(spark, sf_dir):
    """Title, bullets and paragraphs of a page as items, and the self-contained text built again from them in order."""
    item = F.col("item")
    line = F.when(F.startswith(item, F.lit("<h1>")), F.concat(F.lit("# "), F.substring(item, 5, 1 << 30))).when(F.startswith(item, F.lit("<li>")), F.concat(F.lit("- "), F.substring(item, 5, 1 << 30)))
    own = slide_items(spark, sf_dir).select("page_id", F.struct("pos", line.otherwise(F.substring(item, 4, 1 << 30)).alias("line")).alias("x"))
    lists = own.groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("lines"))
    bullets = F.size(F.filter("lines", lambda x: F.startswith(x["line"], F.lit("- "))))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lists.select("page_id", F.size("lines").cast("long").alias("items"), bullets.cast("long").alias("bullets"), F.sha2(text, 256).alias("text_sha256"))


@query("structure_files", [20], f"""WITH {ITEMS_SQL} SELECT kind, level, count(*)::BIGINT AS items, count(DISTINCT doc_id)::BIGINT AS docs, sum(length(line))::BIGINT AS chars FROM items GROUP BY kind, level""")
def structure_files(spark, sf_dir):
    """Documents' structures written as JSON, one object for each document, and loaded again with a schema."""
    place = storage.scratch(spark, "structures")
    lists = items(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "level", "line"))).alias("items"))
    lists.write.json(place)
    loaded = spark.read.schema("doc_id long, items array<struct<pos:long,kind:string,level:long,line:string>>").json(place)
    own = loaded.select("doc_id", F.explode("items").alias("i")).groupBy("i.kind", "i.level")
    return own.agg(F.count("*").alias("items"), F.countDistinct("doc_id").alias("docs"), F.sum(F.length("i.line")).alias("chars"))


SPANS_SQL = r"""s AS (SELECT doc_id, text, generate_subscripts(m, 1) - 1 AS pos, trim(unnest(m)) AS raw FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]+[.!?]?') AS m FROM documents)),
a AS (SELECT doc_id, text, pos, CASE doc_id % 5 WHEN 1 THEN replace(raw, ' ', '  ') WHEN 2 THEN raw || ' zz9' ELSE raw END AS quote FROM s WHERE length(raw) BETWEEN 10 AND 300)"""


@query("verbatim_spans", [190, 191, 193], rf"""WITH {SPANS_SQL}, f AS (SELECT doc_id, pos, quote, strpos(text, quote) AS exact, strpos(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS loose, (length(text) - length(replace(text, quote, ''))) // length(quote) AS times FROM a)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN exact > 0 THEN 'exact' WHEN loose > 0 THEN 'normalised' ELSE 'abstain' END AS status, CASE WHEN exact > 0 THEN exact - 1 WHEN loose > 0 THEN loose - 1 ELSE -1 END::BIGINT AS char_start, CASE WHEN times = 1 THEN 'unique' WHEN times > 1 THEN 'ambiguous' ELSE 'none' END AS quality FROM f""")
def verbatim_spans(spark, sf_dir):
    """Quotes (sentences, some with other white space, some changed) found in their document: exactly, then with white space normalised, else abstain."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))
    texts = read(spark, sf_dir, "documents").select("doc_id", "text", flat("text").alias("plain"))
    docs = texts.select("doc_id", "text", "plain", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))).alias("pos", "raw"))
    raw = docs.withColumn("raw", F.trim("raw")).filter(F.length("raw").between(10, 300))
    quote = F.when(F.col("doc_id") % 5 == 1, F.replace("raw", F.lit(" "), F.lit("  "))).when(F.col("doc_id") % 5 == 2, F.concat("raw", F.lit(" zz9"))).otherwise(F.col("raw"))
    own = raw.withColumn("quote", quote)
    # A text is only searched for what is still open: behind the quote for a second one, or for the loose form where there is none.
    own = own.withColumn("exact", F.instr("text", F.col("quote")))
    there = F.col("exact") > 0
    again = F.instr(F.substr("text", F.col("exact") + F.length("quote")), F.col("quote")) > 0
    own = own.select("doc_id", "pos", "exact", F.when(there, 0).otherwise(F.instr("plain", flat("quote"))).alias("loose"), F.when(there, F.when(again, 2).otherwise(1)).otherwise(0).alias("times"))
    status = F.when(F.col("exact") > 0, "exact").when(F.col("loose") > 0, "normalised").otherwise("abstain")
    start = F.when(F.col("exact") > 0, F.col("exact") - 1).when(F.col("loose") > 0, F.col("loose") - 1).otherwise(-1)
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"), status.alias("status"), start.cast("long").alias("char_start"), F.when(F.col("times") == 1, "unique").when(F.col("times") > 1, "ambiguous").otherwise("none").alias("quality"))


@query("fuzzy_quote_anchors", [194], r"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), qw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM dw WHERE len(w) >= 4)), qg AS (SELECT item_id, i, array_to_string(w[i:i+3], ' ') AS g, len(w) - 3 AS total FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM qw WHERE len(w) >= 4)),
h AS (SELECT doc_id, item_id, dg.i - qg.i AS diagonal, count(*) AS hits, any_value(total) AS total FROM dg JOIN qg USING (g) GROUP BY 1, 2, 3)
SELECT doc_id, item_id, (diagonal + 1)::BIGINT AS first_word, hits::BIGINT AS hits, round(hits::DOUBLE / total, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hits DESC, diagonal) = 1 AND hits * 2 >= total""")
def fuzzy_quote_anchors(spark, sf_dir):
    """Where a quote stands in a document, with some words changed: equal four-word strings at one distance vote for a window; half must agree."""
    def placed(name, key):
        words = read(spark, sf_dir, name).select(key, T.words(F.col("text")).alias("w")).filter(F.size("w") >= 4)
        spans = words.select(key, "w", (F.size("w") - 3).alias("total"), F.explode(F.sequence(F.lit(1), F.size("w") - 3)).alias("i"))
        return spans.select(key, F.xxhash64(F.array_join(F.slice("w", F.col("i"), 4), " ")).alias("g"), "i", "total")

    quotes = placed("benchmark", "item_id").withColumnRenamed("i", "qi")
    hits = placed("documents", "doc_id").drop("total").join(quotes, "g").groupBy("doc_id", "item_id", (F.col("i") - F.col("qi")).alias("diagonal")).agg(F.count("*").alias("hits"), F.first("total").alias("total"))
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("hits", (-F.col("diagonal")).alias("back"), "total")).alias("b"))
    own = best.select("doc_id", "item_id", (1 - F.col("b.back")).cast("long").alias("first_word"), "b.hits", F.round(F.col("b.hits") / F.col("b.total"), 6).alias("score"), "b.total")
    return own.filter("hits * 2 >= total").drop("total")
