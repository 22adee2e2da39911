"""Contracts, validators, promotion, budgets, audits and recovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import vectors as V
from ..sources import storage
from ..sources.statements import STATEMENTS_SQL, statements
from ..sources.tables import read
from ..sources.views import CLAIMS_SQL, FACTS_SQL, OFFERS_SQL, claims, facts, offers
from .registry import query
from .vectors import CENTROIDS_SQL, TO_FACET


@query("quality_gates", [185, 186], rf"""WITH {CENTROIDS_SQL}, n AS (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings), s AS (SELECT vec_id, round({TO_FACET}, 6) AS to_quote, CASE WHEN other IS NULL THEN NULL ELSE round(list_cosine_similarity(embedding::DOUBLE[], other::DOUBLE[]), 6) END AS subject_object FROM n JOIN c ON label = facet),
t AS (SELECT doc_id, max(CASE WHEN regexp_matches(text, '\{{[a-z_]+\}}|\[[A-Z_]{{3,}}\]|TODO|TBD|[%][%][%]') THEN 1 ELSE 0 END) AS leak FROM documents GROUP BY doc_id)
SELECT vec_id, CASE WHEN subject_object > 0.96 THEN 'reject tautology' WHEN leak = 1 THEN 'reject template' WHEN to_quote < 0.2 THEN 'reject unverifiable' WHEN to_quote < 0.3 THEN 'rewrite' WHEN coalesce(subject_object, 1) < 0 THEN 'drop triple' ELSE 'pass' END AS verdict FROM s LEFT JOIN t ON vec_id = doc_id""")
def quality_gates(spark, sf_dir):
    """Gates in order: subject like object, a template's leftovers in the text, text unlike its quote, triple unlike the text."""
    rows = read(spark, sf_dir, "embeddings")
    own = rows.join(V.centroids(rows, "label", "embedding"), "label").withColumn("other", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    scored = own.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("quote"), F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("so"), F.col("other").isNotNull().alias("paired"))
    leaks = read(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max(F.col("text").rlike(r"\{[a-z_]+\}|\[[A-Z_]{3,}\]|TODO|TBD|[%][%][%]")).alias("leak"))
    both = scored.join(leaks, "vec_id", "left")
    so = F.when(F.col("paired"), F.col("so"))
    verdict = F.when(so > 0.96, "reject tautology").when(F.col("leak"), "reject template").when(F.col("quote") < 0.2, "reject unverifiable").when(F.col("quote") < 0.3, "rewrite").when(F.coalesce(so, F.lit(1.0)) < 0, "drop triple").otherwise("pass")
    return both.select("vec_id", verdict.alias("verdict"))


@query("frame_validators", [213], f"""WITH {STATEMENTS_SQL} SELECT finding, count(*)::BIGINT AS frames FROM (SELECT CASE WHEN trim(object_text) = '' THEN 'integrity' WHEN hedge >= 0.1 THEN 'no evidence' WHEN regexp_matches(object_text, '^between') AND regexp_extract(object_text, '([0-9]+) and', 1)::INT > 45 THEN 'consistency' WHEN regexp_matches(object_text, 'colour [^ANR]') THEN 'lexical' WHEN regexp_matches(object_text, '^[0-9]+ %$') AND regexp_extract(object_text, '^([0-9]+)', 1)::INT > 40 THEN 'plausibility' WHEN authority = 'LOW' AND scope = 'R' THEN 'policy' ELSE 'ok' END AS finding FROM statements) GROUP BY finding""")
def frame_validators(spark, sf_dir):
    """The first validator that a statement's frame fails, in a fixed order."""
    text = F.col("object_text")
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    finding = (
        F.when(F.trim(text) == "", "integrity")
        .when(F.col("hedge") >= 0.1, "no evidence")
        .when(text.rlike("^between") & (number("([0-9]+) and") > 45), "consistency")
        .when(text.rlike("colour [^ANR]"), "lexical")
        .when(text.rlike("^[0-9]+ %$") & (number("^([0-9]+)") > 40), "plausibility")
        .when((F.col("authority") == "LOW") & (F.col("scope") == "R"), "policy")
        .otherwise("ok")
    )
    return statements(spark, sf_dir).groupBy(finding.alias("finding")).agg(F.count("*").alias("frames"))


@query("write_contract", [248, 249], f"""WITH {STATEMENTS_SQL}, a AS (SELECT *, CASE line % 3 WHEN 0 THEN 'EXPLICIT' WHEN 1 THEN 'DISCURSIVE' ELSE 'INFERRED' END AS kind, CASE WHEN line <= 2 THEN 'PATTERN' WHEN line <= 5 THEN 'MODEL' ELSE 'HYBRID' END AS method FROM statements)
SELECT kind, method, CASE WHEN kind = 'INFERRED' AND method = 'PATTERN' THEN 'refuse: method' WHEN kind = 'DISCURSIVE' AND hedge < 0.02 THEN 'refuse: no basis' WHEN kind = 'EXPLICIT' AND authority = 'LOW' THEN 'refuse: evidence' ELSE 'write' END AS decision, CASE WHEN kind = 'EXPLICIT' AND authority = 'HIGH' THEN 'STRICT' WHEN kind = 'DISCURSIVE' AND hedge >= 0.05 AND method = 'HYBRID' THEN 'STRICT' ELSE 'EXTENDED' END AS tier, count(*)::BIGINT AS n FROM a GROUP BY ALL""")
def write_contract(spark, sf_dir):
    """Which assertions may be written, by a matrix of kinds, methods and evidence, and in which tier."""
    line = F.col("line")
    kind = F.when(line % 3 == 0, "EXPLICIT").when(line % 3 == 1, "DISCURSIVE").otherwise("INFERRED")
    method = F.when(line <= 2, "PATTERN").when(line <= 5, "MODEL").otherwise("HYBRID")
    own = statements(spark, sf_dir).withColumn("kind", kind).withColumn("method", method)
    is_, hedge = lambda k: F.col("kind") == k, F.col("hedge")
    decision = F.when(is_("INFERRED") & (F.col("method") == "PATTERN"), "refuse: method").when(is_("DISCURSIVE") & (hedge < 0.02), "refuse: no basis").when(is_("EXPLICIT") & (F.col("authority") == "LOW"), "refuse: evidence").otherwise("write")
    tier = F.when(is_("EXPLICIT") & (F.col("authority") == "HIGH"), "STRICT").when(is_("DISCURSIVE") & (hedge >= 0.05) & (F.col("method") == "HYBRID"), "STRICT").otherwise("EXTENDED")
    return own.groupBy("kind", "method", decision.alias("decision"), tier.alias("tier")).agg(F.count("*").alias("n"))


@query("lifecycle_declarations", [320], rf"""WITH {CLAIMS_SQL}, d AS (SELECT doc_id, pos, claim_text AS quote, 0.5 + 0.02 * (length(claim_text) % 25) AS confidence FROM claims), t AS (SELECT sha256(lower(quote)) AS k, count(*) AS n FROM d GROUP BY 1)
SELECT CASE WHEN confidence < 0.7 THEN 'low confidence' WHEN length(quote) < 30 THEN 'short quote' WHEN n > 1 THEN 'target not unique' ELSE 'persist' END AS gate, count(*)::BIGINT AS declarations FROM d JOIN t ON t.k = sha256(lower(quote)) GROUP BY 1""")
def lifecycle_declarations(spark, sf_dir):
    """What of the declarations is kept: sure enough, a quote of 30 characters, and one target."""
    confidence = (50 + 2 * (F.length("claim_text") % 25)) / 100
    own = claims(spark, sf_dir).select(F.length("claim_text").alias("size"), confidence.alias("confidence"), F.sha2(F.lower("claim_text"), 256).alias("k"))
    counted = own.groupBy("k", "size", "confidence").agg(F.count("*").alias("rows"))
    twice = counted.groupBy("k").agg(F.sum("rows").alias("n"))
    gate = F.when(F.col("confidence") < 0.7, "low confidence").when(F.col("size") < 30, "short quote").when(F.col("n") > 1, "target not unique").otherwise("persist")
    return counted.join(twice, "k").groupBy(gate.alias("gate")).agg(F.sum("rows").alias("declarations"))


@query("assertion_promotion", [357, 351], f"""WITH {CLAIMS_SQL}, m AS (SELECT doc_id, pos, claim_text, length(claim_text) AS n, regexp_matches(claim_text, '[0-9]') AS has_value, regexp_matches(claim_text, '[A-Z]{{2,}}') AS has_key, CASE WHEN pos % 4 = 0 THEN 'definition' WHEN pos % 4 = 1 THEN 'fact' WHEN pos % 4 = 2 THEN 'example' ELSE 'meta' END AS role FROM claims)
SELECT role, CASE WHEN role = 'meta' OR n < 15 THEN 'rejected' WHEN role = 'definition' THEN 'linked' WHEN role = 'fact' AND NOT has_key AND NOT has_value THEN 'unlinked' WHEN has_value THEN 'linked' ELSE 'unlinked' END AS status, count(*)::BIGINT AS assertions, round(avg(0.2 * least(n / 100.0, 1) + 0.3 * CASE WHEN has_key THEN 1 ELSE 0 END + 0.2 * CASE WHEN role = 'definition' THEN 1 ELSE 0 END + 0.3 * CASE WHEN has_value THEN 1 ELSE 0 END), 6)::DOUBLE AS score FROM m GROUP BY ALL""")
def assertion_promotion(spark, sf_dir):
    """Assertions that are rejected, linked or left unlinked, by role and content, with a score from anchors, role and value."""
    text, n, at = F.col("claim_text"), F.length("claim_text"), F.col("pos") % 4
    role = F.when(at == 0, "definition").when(at == 1, "fact").when(at == 2, "example").otherwise("meta")
    own = claims(spark, sf_dir).select(role.alias("role"), n.alias("n"), text.rlike("[0-9]").alias("value"), text.rlike("[A-Z]{2,}").alias("key"))
    r, value, key = F.col("role"), F.col("value"), F.col("key")
    status = F.when((r == "meta") | (F.col("n") < 15), "rejected").when(r == "definition", "linked").when((r == "fact") & ~key & ~value, "unlinked").when(value, "linked").otherwise("unlinked")
    score = 0.2 * F.least(F.col("n") / 100.0, F.lit(1.0)) + 0.3 * key.cast("int") + 0.2 * (r == "definition").cast("int") + 0.3 * value.cast("int")
    return own.groupBy("role", status.alias("status")).agg(F.count("*").alias("assertions"), F.round(F.avg(score), 6).alias("score"))


@query("concept_budget", [355, 356], """WITH s AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS n FROM documents), b AS (SELECT *, CASE WHEN n < 30 THEN greatest(10, least(20, n)) WHEN n < 100 THEN 20 + (n - 30) // 5 ELSE least(60, 34 + (n - 100) // 10) END AS budget FROM s)
SELECT source, sum(n)::BIGINT AS sections, sum(budget)::BIGINT AS budget, max(budget)::BIGINT AS largest, round(sum(least(n, budget))::DOUBLE / sum(budget), 6) AS promoted, CASE WHEN sum(least(n, budget))::DOUBLE / sum(budget) > 0.8 THEN 'iterate' ELSE 'saturated' END AS state FROM b GROUP BY source""")
def concept_budget(spark, sf_dir):
    """A budget of concepts for each document by its number of sections, how much of it is used, and whether another round pays."""
    n = F.size(F.split("text", "\n"))
    own = read(spark, sf_dir, "documents").select("source", n.cast("long").alias("n"))
    budget = F.when(F.col("n") < 30, F.greatest(F.lit(10), F.least(F.lit(20), "n"))).when(F.col("n") < 100, 20 + F.floor((F.col("n") - 30) / 5)).otherwise(F.least(F.lit(60), 34 + F.floor((F.col("n") - 100) / 10)))
    own = own.withColumn("budget", budget).groupBy("source").agg(F.sum("n").alias("sections"), F.sum("budget").alias("budget"), F.max("budget").cast("long").alias("largest"), F.sum(F.least("n", "budget")).alias("used"))
    share = F.col("used") / F.col("budget")
    return own.select("source", "sections", "budget", "largest", F.round(share, 6).alias("promoted"), F.when(share > 0.8, "iterate").otherwise("saturated").alias("state"))


@query("concept_quality", [350, 364], f"""WITH {OFFERS_SQL}, c AS (SELECT subject, count(*) AS n, count(DISTINCT source_doc % 3) AS langs, count(DISTINCT claim_type) AS kinds, avg(1 - hedge) AS trust, min(claim_id % 2) AS defined FROM offers GROUP BY subject)
SELECT subject, round((CASE WHEN n >= 30 THEN 0.3 WHEN n >= 20 THEN 0.2 ELSE 0.1 END + CASE WHEN langs >= 3 THEN 0.2 WHEN langs = 2 THEN 0.15 ELSE 0 END + CASE WHEN defined = 0 THEN 0.2 ELSE 0 END + CASE WHEN kinds >= 3 THEN 0.15 ELSE 0 END + 0.15)::DOUBLE, 6) AS quality, CASE WHEN trust >= 0.95 AND langs >= 2 THEN 'solid' WHEN trust >= 0.9 THEN 'fair' ELSE 'weak' END AS solidity FROM c""")
def concept_quality(spark, sf_dir):
    """A concept's quality from support, languages, definition and relations, and how solid its proof is."""
    own = offers(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct(F.col("source_doc") % 3).alias("langs"), F.countDistinct("claim_type").alias("kinds"), F.avg(1 - F.col("hedge")).alias("trust"), F.min(F.col("claim_id") % 2).alias("defined"))
    quality = (
        F.when(F.col("n") >= 30, 0.3).when(F.col("n") >= 20, 0.2).otherwise(0.1) + F.when(F.col("langs") >= 3, 0.2).when(F.col("langs") == 2, 0.15).otherwise(0.0)
        + F.when(F.col("defined") == 0, 0.2).otherwise(0.0) + F.when(F.col("kinds") >= 3, 0.15).otherwise(0.0) + 0.15
    )
    solidity = F.when((F.col("trust") >= 0.95) & (F.col("langs") >= 2), "solid").when(F.col("trust") >= 0.9, "fair").otherwise("weak")
    return own.select("subject", F.round(quality, 6).alias("quality"), solidity.alias("solidity"))


@query("scope_cascade", [361], """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 5 = 0 THEN 'part' END AS own, CASE WHEN s_nationkey % 4 = 0 THEN 'nation' END AS canonical, CASE WHEN o_orderstatus = 'F' THEN 'order' END AS passage, CASE WHEN c_mktsegment < 'G' THEN 'segment' END AS context FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT coalesce(own, canonical, passage, context, 'unresolved') AS scope, count(*)::BIGINT AS claims FROM c GROUP BY 1""")
def scope_cascade(spark, sf_dir):
    """The scope of a claim from the first place that has one: the claim's entity, its canonical entity, the passage, the document."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    nation = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    both = lines.join(nation, "l_suppkey").join(orders, "l_orderkey").join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    scope = F.coalesce(F.when(F.col("l_quantity") % 5 == 0, "part"), F.when(F.col("s_nationkey") % 4 == 0, "nation"), F.when(F.col("o_orderstatus") == "F", "order"), F.when(F.col("c_mktsegment") < "G", "segment"), F.lit("unresolved"))
    return both.groupBy(scope.alias("scope")).agg(F.count("*").alias("claims"))


@query("context_comparability", [363], """WITH d AS (SELECT o_custkey AS doc, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n, o_custkey % 50 AS family FROM orders GROUP BY o_custkey), p AS (SELECT *, lead(doc) OVER w AS other, lead(first) OVER w AS other_first, lead(n) OVER w AS other_n FROM d WINDOW w AS (PARTITION BY family ORDER BY first, doc))
SELECT doc, other, CASE WHEN other_first > last THEN 'ordered' WHEN other_n * 2 < n OR n * 2 < other_n THEN 'not comparable' ELSE 'comparable' END AS relation FROM p WHERE other IS NOT NULL""")
def context_comparability(spark, sf_dir):
    """Whether neighbouring documents of a family can be compared: one after the other, alike in size, or not."""
    docs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n")).withColumn("family", F.col("doc") % 50)
    w = Window.partitionBy("family").orderBy("first", "doc")
    own = docs.select("doc", "last", "n", *[F.lead(c).over(w).alias(f"o_{c}") for c in ("doc", "first", "n")]).filter("o_doc is not null")
    relation = F.when(F.col("o_first") > F.col("last"), "ordered").when((F.col("o_n") * 2 < F.col("n")) | (F.col("n") * 2 < F.col("o_n")), "not comparable").otherwise("comparable")
    return own.select("doc", F.col("o_doc").alias("other"), relation.alias("relation"))


@query("theme_lint", [359], """WITH t AS (SELECT p_type AS theme, count(*) AS parts FROM part GROUP BY 1), i AS (SELECT p_type AS theme, count(*) AS lines, count(*) FILTER (WHERE l_quantity > 49 AND l_discount > 0.08) AS informations FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT theme, parts::BIGINT AS parts, coalesce(informations, 0)::BIGINT AS informations, CASE WHEN coalesce(informations, 0) = 0 AND coalesce(lines, 0) > 0 THEN 'uncovered' WHEN coalesce(informations, 0) * 20 < parts THEN 'thin' ELSE 'ok' END AS finding FROM t LEFT JOIN i USING (theme)""")
def theme_lint(spark, sf_dir):
    """Themes that occur but have no or little information."""
    parts = read(spark, sf_dir, "part")
    themes = parts.groupBy(F.col("p_type").alias("theme")).agg(F.count("*").alias("parts"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), ((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.08)).alias("rich"))
    seen = lines.join(parts.select("p_partkey", F.col("p_type").alias("theme")), "p_partkey").groupBy("theme").agg(F.count("*").alias("lines"), F.count_if("rich").alias("informations"))
    own = themes.join(seen, "theme", "left").fillna(0, ["lines", "informations"])
    finding = F.when((F.col("informations") == 0) & (F.col("lines") > 0), "uncovered").when(F.col("informations") * 20 < F.col("parts"), "thin").otherwise("ok")
    return own.select("theme", "parts", "informations", finding.alias("finding"))


@query("catalogue_normaliser", [367, 360], r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN replace(p_name, ' ', '-') || 's' WHEN p_partkey % 5 = 2 THEN p_name || ' x' ELSE p_name END AS raw FROM part), cat AS (SELECT DISTINCT p_name AS entry FROM part WHERE p_partkey % 2 = 0),
k AS (SELECT entry, regexp_replace(trim(regexp_replace(lower(entry), '[^a-z0-9]+', ' ', 'g')), '([a-z]{3,})s\b', '\1', 'g') AS key FROM cat), r AS (SELECT p_partkey, raw, regexp_replace(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), '([a-z]{3,})s\b', '\1', 'g') AS key FROM n),
b AS (SELECT key, min(entry) AS entry FROM k GROUP BY key) SELECT CASE WHEN cat.entry IS NOT NULL THEN 'exact' WHEN b.entry IS NOT NULL THEN 'structural' ELSE 'uncatalogued' END AS how, count(*)::BIGINT AS names, count(DISTINCT coalesce(cat.entry, b.entry, r.key))::BIGINT AS entries FROM r LEFT JOIN cat ON cat.entry = raw LEFT JOIN b ON b.key = r.key GROUP BY 1""")
def catalogue_normaliser(spark, sf_dir):
    """Raw names to catalogue entries: as they are, by their normal key, else logged as uncatalogued, which become entries of their own."""
    n = F.col("p_partkey") % 5
    raw = F.when(n == 0, F.upper("p_name")).when(n == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("s"))).when(n == 2, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    parts = read(spark, sf_dir, "part")
    names = parts.select(raw.alias("raw")).withColumn("key", T.normal_key(F.col("raw")))
    entries = parts.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("exact")).distinct()
    by_key = entries.groupBy(T.normal_key(F.col("exact")).alias("key")).agg(F.min("exact").alias("structural"))
    both = names.join(entries, names["raw"] == entries["exact"], "left").join(by_key, "key", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("structural").isNotNull(), "structural").otherwise("uncatalogued")
    return both.groupBy(how.alias("how")).agg(F.count("*").alias("names"), F.countDistinct(F.coalesce("exact", "structural", "key")).alias("entries"))


@query("ontology_cycle", [366], """WITH c AS (SELECT p_type AS kind, split_part(p_name, ' ', 2) AS noun, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT noun, sum(n) AS total, count(*) AS kinds, max(n) AS top FROM c GROUP BY noun)
SELECT noun, total::BIGINT AS support, CASE WHEN total >= 30 AND kinds >= 3 THEN 'promoted' WHEN total >= 10 THEN 'proposed' ELSE 'observed' END AS state, CASE WHEN top * 2 > total THEN 'reclassify' ELSE 'keep' END AS action FROM t""")
def ontology_cycle(spark, sf_dir):
    """New types from what names have in common: observed, proposed, promoted by support; those of one kind mostly are reclassified."""
    counts = read(spark, sf_dir, "part").groupBy("p_type", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun")).agg(F.count("*").alias("n"))
    own = counts.groupBy("noun").agg(F.sum("n").alias("support"), F.count("*").alias("kinds"), F.max("n").alias("top"))
    state = F.when((F.col("support") >= 30) & (F.col("kinds") >= 3), "promoted").when(F.col("support") >= 10, "proposed").otherwise("observed")
    return own.select("noun", "support", state.alias("state"), F.when(F.col("top") * 2 > F.col("support"), "reclassify").otherwise("keep").alias("action"))


@query("structured_answers", [368], """WITH a AS (SELECT l_orderkey AS answer, count(*) AS items, count(DISTINCT l_partkey) AS ids, count(*) FILTER (WHERE l_discount = 0) AS unquoted, count(*) FILTER (WHERE l_quantity < 1) AS broken FROM lineitem GROUP BY 1)
SELECT CASE WHEN broken > 0 THEN 'schema' WHEN ids < items THEN 'duplicate ids' WHEN unquoted * 2 > items THEN 'quotes missing' ELSE 'valid' END AS finding, CASE WHEN broken > 0 OR unquoted * 2 > items THEN 'retry' WHEN ids < items THEN 'repair' ELSE 'accept' END AS decision, count(*)::BIGINT AS answers FROM a GROUP BY 1, 2""")
def structured_answers(spark, sf_dir):
    """Lists as answers: schema, ids that repeat, items without a quote, and whether to retry, repair or accept."""
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.countDistinct("l_partkey").alias("ids"), F.count_if(F.col("l_discount") == 0).alias("unquoted"), F.count_if(F.col("l_quantity") < 1).alias("broken"))
    few = F.col("unquoted") * 2 > F.col("items")
    finding = F.when(F.col("broken") > 0, "schema").when(F.col("ids") < F.col("items"), "duplicate ids").when(few, "quotes missing").otherwise("valid")
    decision = F.when((F.col("broken") > 0) | few, "retry").when(F.col("ids") < F.col("items"), "repair").otherwise("accept")
    return own.groupBy(finding.alias("finding"), decision.alias("decision")).agg(F.count("*").alias("answers"))


@query("approximate_distinct", [101], """SELECT l_returnflag, true AS within, count(DISTINCT l_partkey)::BIGINT AS exact FROM lineitem GROUP BY l_returnflag""")
def approximate_distinct(spark, sf_dir):
    """Approximate distinct counts by HyperLogLog++, and whether they are within a tenth of the exact ones."""
    own = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.countDistinct("l_partkey").alias("exact"))
    return own.select("l_returnflag", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within"), "exact")


@query("date_functions", [225], """SELECT o_orderkey, (date_diff('day', o_orderdate, TIMESTAMP '2002-01-01'))::BIGINT AS days, year(o_orderdate)::BIGINT AS year, quarter(o_orderdate)::BIGINT AS quarter, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS month_end, strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS due FROM orders""")
def date_functions(spark, sf_dir):
    """Days until a date, parts of dates, ends of months, durations."""
    day = F.col("o_orderdate")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), day).cast("long").alias("days"), F.year(day).cast("long").alias("year"), F.quarter(day).cast("long").alias("quarter"),
        text(F.last_day(day)).alias("month_end"), text(day + F.expr("INTERVAL 90 DAYS")).alias("due"),
    )


@query("array_functions", [227], """WITH l AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, len(q)::BIGINT AS n, q[1] AS head, len(list_filter(q, lambda x: x > 45)) > 0 AS any_large, len(list_filter(q, lambda x: x > 5)) = len(q) AS all_above, list_sum(list_transform(q, lambda x: x * x)) AS squares FROM l""")
def array_functions(spark, sf_dir):
    """Any, all, size, head, reduce over the values of a group."""
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q"))
    squares = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    return own.select("l_orderkey", F.size("q").cast("long").alias("n"), F.col("q")[0].alias("head"), F.exists("q", lambda x: x > 45).alias("any_large"), F.forall("q", lambda x: x > 5).alias("all_above"), squares.alias("squares"))


@query("trace_spans", [305], """WITH s AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS trace FROM events)
SELECT user_id, trace::BIGINT AS trace, count(*)::BIGINT AS spans, bool_or(event_type = 'error') AS failed, round(sum(date_diff('microsecond', ts, coalesce(until, ts)))::DOUBLE / 1e6, 3) AS seconds FROM s GROUP BY user_id, trace""")
def trace_spans(spark, sf_dir):
    """Spans under the trace that is open for a user: number, duration, and whether one failed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opened = F.sum((F.col("event_type") == "signup").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = read(spark, sf_dir, "events").select("user_id", "event_type", opened.alias("trace"), F.timestamp_diff("MICROSECOND", F.col("ts"), F.coalesce(F.lead("ts").over(w), F.col("ts"))).alias("micros"))
    return own.groupBy("user_id", "trace").agg(F.count("*").alias("spans"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.round(F.sum("micros") / 1e6, 3).alias("seconds"))


@query("crash_recovery", [307, 306], f"""WITH {FACTS_SQL}, j AS (SELECT fact_id, subject, CASE WHEN status = 'approved' THEN 'done' WHEN valid_until IS NULL THEN 'running' ELSE 'queued' END AS state, valid_from FROM facts)
SELECT state, CASE WHEN state = 'running' THEN 're-enqueue' WHEN state = 'queued' AND valid_from < TIMESTAMP '2024-01-10' THEN 'purge' ELSE 'keep' END AS action, count(*)::BIGINT AS jobs FROM j GROUP BY 1, 2""")
def crash_recovery(spark, sf_dir):
    """Jobs after a crash: what ran is put back into the queue, what waited too long is purged, the rest stays."""
    state = F.when(F.col("status") == "approved", "done").when(F.col("valid_until").isNull(), "running").otherwise("queued")
    own = facts(spark, sf_dir).select(state.alias("state"), "valid_from")
    old = F.col("valid_from") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    action = F.when(F.col("state") == "running", "re-enqueue").when((F.col("state") == "queued") & old, "purge").otherwise("keep")
    return own.groupBy("state", action.alias("action")).agg(F.count("*").alias("jobs"))


@query("payload_cross_reference", [18], """WITH p AS (SELECT vec_id % 1000 AS chunk, vec_id FROM embeddings), n AS (SELECT doc_id % 1000 AS chunk, doc_id FROM documents)
SELECT 'point' AS side, vec_id AS id, (SELECT count(*) FROM n WHERE n.chunk = p.chunk)::BIGINT AS links FROM p UNION ALL SELECT 'node', doc_id, (SELECT count(*) FROM p WHERE p.chunk = n.chunk)::BIGINT FROM n""")
def payload_cross_reference(spark, sf_dir):
    """Vector points and information nodes of one chunk, referred to from both sides; counts of each side meet, not their pairs."""
    points = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 1000).alias("chunk"), F.col("vec_id").alias("id"))
    nodes = read(spark, sf_dir, "documents").select((F.col("doc_id") % 1000).alias("chunk"), F.col("doc_id").alias("id"))
    place = storage.scratch(spark, "references")

    def linked(own, other, side):
        counts = other.groupBy("chunk").agg(F.count("*").alias("links"))
        return own.join(counts, "chunk", "left").select(F.lit(side).alias("side"), "id", F.coalesce("links", F.lit(0)).alias("links"))

    linked(points, nodes, "point").unionByName(linked(nodes, points, "node")).write.parquet(place)
    return spark.read.parquet(place)
