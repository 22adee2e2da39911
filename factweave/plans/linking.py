"""Links between concepts, documents and claims; clusters by zone and by threshold; traces of decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import vectors as V
from ..sources.statements import STATEMENTS_SQL, statements
from ..sources.tables import read
from ..sources.views import CLAIMS_SQL, FACTS_SQL, claims, facts
from .registry import query
from .vectors import CENTROIDS_SQL



@query("pairwise_relations", [240], rf"""WITH {CLAIMS_SQL}, w AS (SELECT doc_id, pos, claim_text, list_distinct(regexp_extract_all(lower(claim_text), '[\p{{L}}\p{{N}}]{{4,}}')) AS w, len(regexp_extract_all(lower(claim_text), '[\p{{L}}\p{{N}}]+')) AS n FROM claims),
p AS (SELECT doc_id, pos, w, lead(w) OVER o AS v, n, lead(n) OVER o AS m, claim_text AS a, lead(claim_text) OVER o AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, len(list_intersect(w, v)) AS shared, CASE WHEN regexp_matches(' ' || lower(a) || ' ', ' (not|no|pas|nicht|kein) ') <> regexp_matches(' ' || lower(b) || ' ', ' (not|no|pas|nicht|kein) ') THEN 'CONTRADICTS' WHEN m > 1.5 * n THEN 'REFINES' WHEN regexp_matches(' ' || lower(b) || ' ', ' (if|when|only|for|si|wenn|pour|für) ') THEN 'QUALIFIES' ELSE 'NONE' END AS relation FROM p WHERE v IS NOT NULL)
SELECT relation, count(*)::BIGINT AS pairs, round(CASE relation WHEN 'CONTRADICTS' THEN 0.8 WHEN 'REFINES' THEN 0.75 WHEN 'QUALIFIES' THEN 0.7 ELSE 0 END, 6)::DOUBLE AS confidence FROM r WHERE shared >= 2 GROUP BY relation""")
def pairwise_relations(spark, sf_dir):
    """Neighbouring sentences of a document that share two words: contradicting (one negated), refining (much longer), qualifying (a condition)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    low = F.lower("claim_text")
    own = claims(spark, sf_dir).select(
        "doc_id", "pos", F.concat(F.lit(" "), low, F.lit(" ")).alias("t"), F.size(T.words(F.col("claim_text"))).alias("n"), F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0))).alias("w")
    )
    both = own.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("t", "n", "w")]).filter("next_w is not null").filter(F.size(F.array_intersect("w", "next_w")) >= 2)
    negated = lambda c: F.col(c).rlike(" (not|no|pas|nicht|kein) ")
    relation = F.when(negated("t") != negated("next_t"), "CONTRADICTS").when(F.col("next_n") > 1.5 * F.col("n"), "REFINES").when(F.col("next_t").rlike(" (if|when|only|for|si|wenn|pour|für) "), "QUALIFIES").otherwise("NONE")
    sure = F.when(F.col("relation") == "CONTRADICTS", 0.8).when(F.col("relation") == "REFINES", 0.75).when(F.col("relation") == "QUALIFIES", 0.7).otherwise(0.0)
    return both.groupBy(relation.alias("relation")).agg(F.count("*").alias("pairs")).withColumn("confidence", sure)


@query("document_coherence", [108], f"""WITH {CENTROIDS_SQL}, s AS (SELECT vec_id, vec_id % 40 AS doc, facet, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS score FROM embeddings CROSS JOIN c), b AS (SELECT vec_id, doc, max(struct_pack(s := score, f := -facet)) AS best FROM s GROUP BY ALL),
a AS (SELECT vec_id, doc, CASE WHEN best.s >= 0.3 THEN -best.f END AS facet FROM b), n AS (SELECT doc, facet, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc) AS claims FROM a GROUP BY doc, facet), d AS (SELECT doc, facet AS dominant FROM n WHERE facet IS NOT NULL AND claims >= 5 AND n >= 0.15 * claims QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, facet) = 1)
SELECT a.vec_id, dominant::BIGINT AS facet, round(0.9 * score, 6) AS score FROM a JOIN d USING (doc) JOIN s ON s.vec_id = a.vec_id AND s.facet = dominant WHERE a.facet IS NULL AND score >= 0.1""")
def document_coherence(spark, sf_dir):
    """A second pass: claims without a facet take the one that dominates their document, if it is near enough, at 0.9 of the score.

    The thresholds (0.3 to be assigned, 0.15 to dominate, 0.1 to follow) suit these vectors.
    """
    rows = read(spark, sf_dir, "embeddings")
    centers = V.centroids(rows, "label", "embedding").withColumnRenamed("label", "facet")
    scored = rows.crossJoin(F.broadcast(centers)).select("vec_id", (F.col("vec_id") % 40).alias("doc"), "facet", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("score"))
    best = scored.groupBy("vec_id", "doc").agg(F.max(F.struct("score", (-F.col("facet")).alias("f"))).alias("b"))
    own = best.select("vec_id", "doc", F.when(F.col("b.score") >= 0.3, -F.col("b.f")).alias("own"))
    counts = own.groupBy("doc", "own").agg(F.count("*").alias("n")).withColumn("claims", F.sum("n").over(Window.partitionBy("doc")))
    strong = counts.filter("own is not null and claims >= 5 and n >= 0.15 * claims")
    order = Window.partitionBy("doc").orderBy(F.desc("n"), "own")
    dominant = strong.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("doc", F.col("own").alias("facet"))
    loose = own.filter("own is null").select("vec_id", "doc").join(dominant, "doc")
    return loose.join(scored.drop("doc"), ["vec_id", "facet"]).filter("score >= 0.1").select("vec_id", F.col("facet").cast("long").alias("facet"), F.round(0.9 * F.col("score"), 6).alias("score"))


@query("decision_traces", [319, 318], f"""WITH {FACTS_SQL}, d AS (SELECT subject, fact_id, predicate, status, valid_from, row_number() OVER (PARTITION BY subject ORDER BY valid_from, fact_id) AS step, lag(status) OVER (PARTITION BY subject ORDER BY valid_from, fact_id) AS before FROM facts)
SELECT subject, count(*)::BIGINT AS decisions, count(*) FILTER (WHERE before IS NOT NULL AND before <> status)::BIGINT AS reversals, sha256(string_agg(step || ':' || predicate || '=' || status, ';' ORDER BY step)) AS trace FROM d GROUP BY subject""")
def decision_traces(spark, sf_dir):
    """The ordered decisions on each subject, how often they turned, and the trace's checksum."""
    w = Window.partitionBy("subject").orderBy("valid_from", "fact_id")
    own = facts(spark, sf_dir).select("subject", "predicate", "status", F.row_number().over(w).alias("step"), F.lag("status").over(w).alias("before"))
    line = F.concat(F.col("step").cast("string"), F.lit(":"), "predicate", F.lit("="), "status")
    lists = own.groupBy("subject").agg(F.count("*").alias("decisions"), F.count_if(F.col("before") != F.col("status")).alias("reversals"), F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("lines"))
    return lists.select("subject", "decisions", "reversals", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), ";"), 256).alias("trace"))


@query("scoped_mentions", [37], f"""WITH {CLAIMS_SQL}, t AS (SELECT doc_id, n_chars % 3 = 0 AS topic FROM documents) SELECT source, lang, count(*)::BIGINT AS mentions, count(DISTINCT c.doc_id)::BIGINT AS docs FROM claims c JOIN t USING (doc_id) WHERE topic AND pos < 8 AND contains(lower(claim_text), 'the') GROUP BY ALL""")
def scoped_mentions(spark, sf_dir):
    """Mentions of a word within the scope of a topic's documents and their first sections."""
    topic = read(spark, sf_dir, "documents").filter("n_chars % 3 = 0").select("doc_id").distinct()
    own = claims(spark, sf_dir).filter((F.col("pos") < 8) & F.contains(F.lower("claim_text"), F.lit("the"))).join(topic, "doc_id", "left_semi")
    return own.groupBy("source", "lang").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))


@query("concept_documents", [348], r"""WITH b AS (SELECT DISTINCT lower(regexp_extract(text, '[\p{L}]{7,}')) AS concept FROM benchmark), t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(w) AS concept, generate_subscripts(w, 1) AS i FROM t),
m AS (SELECT doc_id, p.concept, i, len(w) AS n, array_to_string(w[greatest(1, i - 2):i + 2], ' ') AS around, row_number() OVER (PARTITION BY doc_id, p.concept ORDER BY i) AS rn FROM p JOIN b ON p.concept = b.concept WHERE b.concept <> '')
SELECT doc_id, concept, count(*)::BIGINT AS mentions, CASE WHEN min(i) <= 0.1 * max(n) AND count(*) >= 2 THEN 'defines' WHEN count(*) >= 2 THEN 'discusses' ELSE 'mentions' END AS role, max(CASE WHEN rn = 1 THEN around END) AS context FROM m GROUP BY doc_id, concept""")
def concept_documents(spark, sf_dir):
    """Which documents have a concept, in what role, and the words around its first mention."""
    concepts = read(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", r"[\p{L}]{7,}", 0)).alias("concept")).filter("concept != ''").distinct()
    docs = read(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    words = docs.select("doc_id", F.size("w").alias("n"), F.explode(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("concept")))).alias("x"))
    own = words.select("doc_id", "n", (F.col("x.i") + 1).alias("i"), "x.concept").join(concepts, "concept").groupBy("doc_id", "concept", "n").agg(F.count("*").alias("mentions"), F.min("i").alias("first"))
    role = F.when((F.col("first") <= 0.1 * F.col("n")) & (F.col("mentions") >= 2), "defines").when(F.col("mentions") >= 2, "discusses").otherwise("mentions")
    start = F.greatest(F.lit(1), F.col("first") - 2)
    around = F.array_join(F.slice("w", start, F.col("first") + 3 - start), " ")
    return own.join(docs, "doc_id").select("doc_id", "concept", "mentions", role.alias("role"), around.alias("context"))


@query("threshold_clusters", [166], """WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id // 50 = b.vec_id // 50 WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.2),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT a AS node, a AS other FROM u UNION SELECT walk.node, u.b FROM walk JOIN u ON walk.other = u.a) SELECT node, min(other) AS cluster FROM walk GROUP BY node""")
def threshold_clusters(spark, sf_dir):
    """Single-link clusters of names by cosine: names meet within blocks (label and a run of fifty ids), so blocks stay small; links join them."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", F.floor(F.col("vec_id") / 50).alias("run"))
    one, two = rows.alias("x"), rows.alias("y")
    both = one.join(two, (F.col("x.label") == F.col("y.label")) & (F.col("x.run") == F.col("y.run")) & (F.col("x.vec_id") < F.col("y.vec_id")))
    near = both.filter(F.round(V.cosine(F.col("x.embedding"), F.col("y.embedding")), 6) >= 0.2)
    return G.components(near.select(F.col("x.vec_id").alias("src"), F.col("y.vec_id").alias("dst"))).select("node", F.col("component").alias("cluster"))


@query("zone_clusters", [270], """WITH z AS (SELECT vec_id, label, (CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END) AS side, embedding FROM embeddings), p AS (SELECT label * 10 + side AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM z), m AS (SELECT cluster, i, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT cluster, list(x ORDER BY i) AS v FROM m GROUP BY cluster), n AS (SELECT label * 10 + side AS cluster, count(*) AS n FROM z GROUP BY 1)
SELECT a.cluster::BIGINT AS a, b.cluster::BIGINT AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, (x.n + y.n)::BIGINT AS members FROM c a JOIN c b ON a.cluster < b.cluster AND a.cluster // 10 <> b.cluster // 10 JOIN n x ON x.cluster = a.cluster JOIN n y ON y.cluster = b.cluster WHERE x.n >= 3 AND y.n >= 3 AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.4""")
def zone_clusters(spark, sf_dir):
    """Clusters within zones first (inventory row 275): a zone's vectors by the signs of two components; clusters of three at least from
    different zones are then fused where their centroids are alike. What is paired are clusters, four for each zone."""
    rows = read(spark, sf_dir, "embeddings")
    sign = lambda i, w: F.when(F.element_at("embedding", i) > 0, w).otherwise(0)
    zoned = rows.select("embedding", (F.col("label") * 10 + sign(1, 1) + sign(2, 2)).cast("long").alias("cluster"))
    centers = V.centroids(zoned, "cluster", "embedding").join(zoned.groupBy("cluster").agg(F.count("*").alias("n")).filter("n >= 3"), "cluster")
    a, b = (centers.select(F.col("cluster").alias(s), F.col("centroid").alias(f"v_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    both = a.join(b, (F.col("a") < F.col("b")) & (F.floor(F.col("a") / 10) != F.floor(F.col("b") / 10)))
    return both.select("a", "b", F.round(V.cosine(F.col("v_a"), F.col("v_b")), 6).alias("similarity"), (F.col("n_a") + F.col("n_b")).alias("members")).filter("similarity >= 0.4")


@query("session_concepts", [365], r"""WITH t AS (SELECT conv_id, lower(role) AS role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM conversations), k AS (SELECT w FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) WHERE length(w) >= 9 GROUP BY w HAVING count(*) >= 5)
SELECT conv_id, w AS concept, count(*)::BIGINT AS mentions, count(*) FILTER (WHERE role = 'user')::BIGINT AS by_user FROM t JOIN k USING (w) GROUP BY ALL""")
def session_concepts(spark, sf_dir):
    """Concepts (long words that five documents have) in each conversation's messages, and how often the user brought them up."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).filter(F.length("w") >= 9)
    known = docs.groupBy("w").agg(F.countDistinct("doc_id").alias("docs")).filter("docs >= 5").select("w")
    words = read(spark, sf_dir, "conversations").select("conv_id", F.lower("role").alias("role"), F.explode(T.words(F.col("text"))).alias("w"))
    return words.join(known, "w").groupBy("conv_id", F.col("w").alias("concept")).agg(F.count("*").alias("mentions"), F.count_if(F.col("role") == "user").alias("by_user"))


@query("multi_mention_scores", [352], f"""WITH {STATEMENTS_SQL}, m AS (SELECT subject, order_id, CASE WHEN authority = 'HIGH' THEN 1.0 WHEN authority = 'MEDIUM' THEN 0.6 ELSE 0.3 END * (1 - hedge) AS like_core, CASE WHEN line > 4 THEN 0.8 ELSE 0.2 END AS like_rival FROM statements)
SELECT subject, count(*)::BIGINT AS mentions, round(avg(like_core), 6)::DOUBLE AS core, round(avg(like_rival), 6)::DOUBLE AS rival, CASE WHEN avg(like_core) > avg(like_rival) + 0.1 THEN 'PRIMARY' WHEN avg(like_rival) > avg(like_core) + 0.1 THEN 'COMPETITOR' ELSE 'SECONDARY' END AS role FROM m GROUP BY subject""")
def multi_mention_scores(spark, sf_dir):
    """A concept's role from all its mentions: each is compared with the roles' prototypes, and the means decide.

    As in the SQL, rival prototypes are decimals, whose mean is exact, and a mean is rounded as a double, after its product with 10^6.
    """
    weight = F.when(F.col("authority") == "HIGH", 1.0).when(F.col("authority") == "MEDIUM", 0.6).otherwise(0.3)
    own = statements(spark, sf_dir).select("subject", (weight * (1 - F.col("hedge"))).alias("a"), F.when(F.col("line") > 4, 8).otherwise(2).alias("tenths"))
    means = own.groupBy("subject").agg(F.count("*").alias("mentions"), F.avg("a").alias("a"), (F.sum("tenths") / (10 * F.count("*"))).alias("b"))
    role = F.when(F.col("a") > F.col("b") + 0.1, "PRIMARY").when(F.col("b") > F.col("a") + 0.1, "COMPETITOR").otherwise("SECONDARY")
    rounded = lambda c: F.round(F.col(c) * 1e6) / 1e6
    return means.select("subject", "mentions", rounded("a").alias("core"), rounded("b").alias("rival"), role.alias("role"))
