"""Sources, sinks, caches and structure of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import storage
from ..sources.tables import read
from ..sources.views import CLAIMS_SQL, claims
from .registry import query


@query("file_router", [1], """SELECT CASE WHEN regexp_matches(url, '\\.html?([?#]|$)') THEN 'html' WHEN regexp_matches(url, '\\.pdf([?#]|$)') THEN 'pdf' WHEN contains(url, '?') THEN 'query' ELSE 'folder' END AS loader, count(*)::BIGINT AS files FROM pages GROUP BY 1""")
def file_router(spark, sf_dir):
    url = F.col("url")
    loader = F.when(url.rlike(r"\.html?([?#]|$)"), "html").when(url.rlike(r"\.pdf([?#]|$)"), "pdf").when(F.contains(url, F.lit("?")), "query").otherwise("folder")
    return read(spark, sf_dir, "pages").groupBy(loader.alias("loader")).agg(F.count("*").alias("files"))


@query("extraction_cache", [10], """SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS cached FROM documents""")
def extraction_cache(spark, sf_dir):
    """A document whose content came earlier needs no extraction: the first of each content hash is an aggregate, joined back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "hash").select("doc_id", (F.col("doc_id") > F.col("first")).alias("cached"))


@query("artifact_round_trip", [11, 12, 17], """SELECT label, count(*)::BIGINT AS vectors, min(vec_id) AS first FROM embeddings GROUP BY label""")
def artifact_round_trip(spark, sf_dir):
    """Vectors exported with checksums and a manifest, and imported again."""
    place = storage.scratch(spark, "artifact")
    storage.export_artifact(read(spark, sf_dir, "embeddings"), "vec_id", place)
    return storage.import_artifact(spark, place).groupBy("label").agg(F.count("*").alias("vectors"), F.min("vec_id").alias("first"))


@query("vector_upsert", [13, 14, 15], """SELECT label, count(*)::BIGINT AS vectors FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label FROM embeddings WHERE label <> 4) GROUP BY label""")
def vector_upsert(spark, sf_dir):
    """New versions replace old ones, and a deleted group's vectors go."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    new = rows.filter("vec_id % 3 = 0").select("vec_id", F.lit(99).alias("label"), F.lit(2).alias("version"))
    gone = rows.filter("label = 4").select("vec_id")
    return storage.delete_where(storage.upsert(rows, new, ["vec_id"], "version"), gone, "vec_id").groupBy("label").agg(F.count("*").alias("vectors"))


@query("property_merge", [16], """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment || '+' END, c_mktsegment) AS segment, c_nationkey FROM customer""")
def property_merge(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_nationkey")
    new = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", F.concat("c_mktsegment", F.lit("+")).alias("segment"), F.lit(None).cast("int").alias("c_nationkey"))
    return storage.merge_properties(old, new, ["c_custkey"])


@query("json_trace_sink", [19, 228], r"""SELECT event_type, count(*)::BIGINT AS events, sum(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type""")
def json_trace_sink(spark, sf_dir):
    """Events appended as lines of JSON, read back with a schema."""
    place = storage.scratch(spark, "trace")
    read(spark, sf_dir, "events").select("event_id", "event_type", "props").write.mode("append").json(place)
    lines = spark.read.schema("event_id long, event_type string, props string").json(place)
    k = F.get_json_object("props", "$.k").cast("long")
    return lines.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("total"))


@query("page_items", [23], r"""WITH i AS (SELECT page_id, generate_subscripts(m, 1) AS pos, unnest(m) AS item FROM (SELECT page_id, regexp_extract_all(html, '<(?:p|h1|li)>[^<]*') AS m FROM pages))
SELECT page_id, count(*)::BIGINT AS items, count(*) FILTER (WHERE starts_with(item, '<h1>'))::BIGINT AS titles, max(length(item))::BIGINT AS longest FROM i GROUP BY page_id""")
def page_items(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(?:p|h1|li)>[^<]*"), F.lit(0))).alias("item"))
    own = found.groupBy("page_id")
    return own.agg(F.count("*").alias("items"), F.count_if(F.startswith("item", F.lit("<h1>"))).alias("titles"), F.max(F.length("item")).cast("long").alias("longest"))


@query("section_profiles", [172], """WITH l AS (SELECT doc_id, generate_subscripts(m, 1) AS pos, unnest(m) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS m FROM documents)),
s AS (SELECT doc_id, line, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, count(*)::BIGINT AS lines, sum(length(line))::BIGINT AS chars, round(avg(CASE WHEN contains(line, '|') THEN 1.0 ELSE 0.0 END), 6) AS tables FROM s GROUP BY doc_id, section""")
def section_profiles(spark, sf_dir):
    """A short line opens a section; each section's lines, length and share of table rows."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("section", F.sum((F.length("line") < 60).cast("long")).over(w)).groupBy("doc_id", "section")
    tables = F.round(F.avg(F.contains("line", F.lit("|")).cast("double")), 6)
    return own.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), tables.alias("tables"))


@query("verbatim_validation", [62, 190, 358], rf"""WITH {CLAIMS_SQL}
SELECT doc_id, pos::BIGINT AS pos, strpos(text, claim_text)::BIGINT AS char_start, (length(text) - length(replace(text, claim_text, ''))) // length(claim_text) AS occurrences, length(claim_text) BETWEEN 10 AND 1000 AS valid_length
FROM claims JOIN documents USING (doc_id)""")
def verbatim_validation(spark, sf_dir):
    """Each sentence found again in its document: where it stands and how often, worked out in the document's own row."""
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))).alias("pos", "raw"))
    own = found.withColumn("claim_text", F.trim("raw")).filter(F.length("claim_text") >= 10)
    times = ((F.length("text") - F.length(F.replace("text", F.col("claim_text")))) / F.length("claim_text")).cast("long")
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"), F.instr("text", F.col("claim_text")).cast("long").alias("char_start"), times.alias("occurrences"), F.length("claim_text").between(10, 1000).alias("valid_length"))


@query("trigger_ngrams", [198], r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), g AS (SELECT DISTINCT doc_id, lang, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)),
n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
SELECT lang, gram, count(*)::BIGINT AS docs FROM g JOIN n USING (lang) GROUP BY lang, gram, n.docs HAVING count(*) BETWEEN 0.3 * n.docs AND 0.7 * n.docs AND count(*) >= 5""")
def trigger_ngrams(spark, sf_dir):
    """Word pairs in 30 to 70 % of a language's documents."""
    docs = read(spark, sf_dir, "documents")
    words = docs.select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).filter(F.size("w") >= 2)
    grams = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    counts = words.select("lang", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("docs"))
    totals = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(totals), "lang").filter("docs between 0.3 * n and 0.7 * n and docs >= 5").select("lang", "gram", "docs")


@query("pattern_mining", [353], f"""WITH {CLAIMS_SQL}, w AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(claim_text), '[a-z]{{7,}}')) AS concept FROM claims)
SELECT concept, count(*)::BIGINT AS docs, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT source) >= 5 AS bridge FROM w GROUP BY concept HAVING count(*) >= 10""")
def pattern_mining(spark, sf_dir):
    """Concepts that recur in many documents, and those that bridge sources."""
    own = claims(spark, sf_dir).select("doc_id", "source", F.explode(F.regexp_extract_all(F.lower("claim_text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("concept")).distinct()
    return own.groupBy("concept").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), (F.countDistinct("source") >= 5).alias("bridge")).filter("docs >= 10")


@query("acronym_map", [167], r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS name FROM documents),
i AS (SELECT name, array_to_string(list_transform(string_split(name, ' '), lambda x: substr(x, 1, 1)), '') AS acronym FROM w)
SELECT acronym, count(*)::BIGINT AS mentions, count(DISTINCT name)::BIGINT AS expansions FROM i GROUP BY acronym""")
def acronym_map(spark, sf_dir):
    """Initials of capitalised names, with how many names they stand for."""
    pattern = "[A-Z][a-z]+ [A-Z][a-z]+(?: [A-Z][a-z]+)*"
    names = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("name"))
    initials = F.array_join(F.transform(F.split("name", " "), lambda w: F.substring(w, 1, 1)), "")
    return names.groupBy(initials.alias("acronym")).agg(F.count("*").alias("mentions"), F.countDistinct("name").alias("expansions"))


@query("text_measures", [224, 226], """SELECT doc_id, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '[^ \n]+'))::BIGINT AS words, round(sqrt(length(text)) + log2(1 + length(text)), 6) AS measure, upper(substr(text, 1, 3)) AS head FROM documents""")
def text_measures(spark, sf_dir):
    """Sizes, words, a measure and the head of a text in upper case, letter by letter: ß becomes ẞ, not two letters."""
    size = F.length("text")
    words = T.count_matches(F.col("text"), "[^ \n]+")
    return read(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("chars"), words.alias("words"), F.round(F.sqrt(size) + F.log2(1 + size), 6).alias("measure"), F.upper(F.replace(F.substring("text", 1, 3), F.lit("ß"), F.lit("ẞ"))).alias("head"))
