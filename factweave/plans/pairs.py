"""Candidate pairs: blocks, pivots, signals, gates, caches and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import vectors as V
from ..sources.statements import STATEMENTS_SQL, statements
from ..sources.tables import read
from ..sources.views import CLAIMS_SQL, FACTS_SQL, claims, facts
from .entities import PAIRS_SQL, pairs
from .graph import EDGES_SQL, edges
from .registry import query
from .values import PREVIOUS_SQL, previous
from .vectors import CENTROIDS_SQL

LABELS_SQL = """labels_of AS (SELECT p_name || ' ' || lower(p_type) AS name, count(*) AS support FROM part GROUP BY 1)"""


def labels(spark, sf_dir):
    """Distinct labels of parts, with how many parts have them."""
    return read(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).agg(F.count("*").alias("support"))


@query("blocking_keys", [59], f"""WITH {LABELS_SQL}, k AS (SELECT name, 'a:' || array_to_string(list_transform(string_split(name, ' '), lambda w: substr(w, 1, 1)), '') || ':' || right(name, 2) AS key FROM labels_of UNION SELECT name, 'p:' || substr(name, 1, 3) || ':' || right(name, 3) FROM labels_of)
SELECT a.name AS a, b.name AS b, count(*)::BIGINT AS keys FROM k a JOIN k b ON a.key = b.key AND a.name < b.name GROUP BY ALL""")
def blocking_keys(spark, sf_dir):
    """Candidate pairs of labels that share an acronym key or a prefix key: keys are exploded and met by an equi-join."""
    name = F.col("name")
    acronym = F.concat(F.lit("a:"), F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), ""), F.lit(":"), F.right(name, F.lit(2)))
    prefix = F.concat(F.lit("p:"), F.substring(name, 1, 3), F.lit(":"), F.right(name, F.lit(3)))
    keyed = labels(spark, sf_dir).select("name", F.explode(F.array(acronym, prefix)).alias("key")).distinct()
    both = keyed.select(F.col("name").alias("a"), "key").join(keyed.select(F.col("name").alias("b"), "key"), "key").filter("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("keys"))


@query("rare_token_pairs", [60], r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents), r AS (SELECT w FROM t WHERE length(w) >= 6 GROUP BY w HAVING count(*) BETWEEN 2 AND 3),
o AS (SELECT doc_id, w FROM t JOIN r USING (w)), n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id), s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM o a JOIN o b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, shared::BIGINT AS shared, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 2""")
def rare_token_pairs(spark, sf_dir):
    """Documents that share words which occur in two or three documents only, so that a word makes three pairs at most; Jaccard over these words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).filter(F.length("w") >= 6)
    rare = docs.groupBy("w").agg(F.count("*").alias("n")).filter("n between 2 and 3").select("w")
    own = docs.join(rare, "w")
    sizes = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = own.select(F.col("doc_id").alias("a"), "w").join(own.select(F.col("doc_id").alias("b"), "w"), "w").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter("shared >= 2")
    sized = shared.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


@query("pivot_pairs", [56], """WITH c AS (SELECT l_partkey AS entity, l_suppkey AS doc, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, doc) AS rn, count(*) OVER (PARTITION BY entity) AS docs FROM c),
t AS (SELECT entity, row_number() OVER (ORDER BY docs DESC, entity) AS place FROM r WHERE rn = 1 AND docs >= 2 QUALIFY place <= 500)
SELECT a.entity, a.doc AS a, b.doc AS b, a.docs::BIGINT AS docs FROM r a JOIN r b ON a.entity = b.entity AND b.rn = a.rn + 1 LEFT JOIN t ON t.entity = a.entity WHERE a.rn = 1 OR (t.entity IS NOT NULL AND a.rn <= 3)""")
def pivot_pairs(spark, sf_dir):
    """Pairs of documents by an entity they share: one for each entity in two documents at least, and two more for the 500 that are in most."""
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("doc")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("entity")
    order = own.orderBy(F.desc("n"), "doc")
    ranked = counts.select("entity", F.col("doc").alias("a"), F.lead("doc").over(order).alias("b"), F.row_number().over(order).alias("rn"), F.count("*").over(own).alias("docs")).filter("rn <= 3 and b is not null")
    deep = ranked.filter("rn = 1").orderBy(F.desc("docs"), "entity").limit(500).select("entity", F.lit(True).alias("deep"))
    return ranked.join(deep, "entity", "left").filter("rn = 1 or deep").select("entity", "a", "b", "docs")


@query("new_pairs", [55], f"""WITH {EDGES_SQL}, c AS (SELECT l_partkey, l_suppkey AS doc, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS other FROM lineitem),
p AS (SELECT DISTINCT least(doc, other) AS a, greatest(doc, other) AS b FROM c WHERE other IS NOT NULL AND doc <> other), seen AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE n >= 3)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.a = p.a AND seen.b = p.b)""")
def new_pairs(spark, sf_dir):
    """Candidate pairs without those that have a relation already: an anti-join on the normalised pair."""
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    near = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.lead("l_suppkey").over(w).alias("other")).filter("other is not null and doc != other")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    seen = edges(spark, sf_dir).filter("n >= 3").select(*pair("src", "dst")).distinct()
    return near.select(*pair("doc", "other")).distinct().join(seen, ["a", "b"], "left_anti")


@query("signal_pairs", [150], """WITH o AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM o x JOIN o y ON x.label = y.label AND y.rn IN (x.rn + 1, x.rn + 2)),
s AS (SELECT a, b, round(0.30::DOUBLE * cosine + 0.25::DOUBLE * (CASE WHEN a % 5 = b % 5 THEN 1 ELSE 0 END) + 0.15::DOUBLE * (CASE WHEN a % 2 = b % 2 THEN 1 ELSE 0 END) + 0.20::DOUBLE + 0.10::DOUBLE * (CASE WHEN b - a <= 10 THEN 1 ELSE 0 END), 6) AS score FROM p) SELECT a, b, score FROM s WHERE score >= 0.55""")
def signal_pairs(spark, sf_dir):
    """Pairs of members of a cluster (inventory row 58): cosine, shared entity, shared facet, cluster and graph as weighted signals, 0.55 at least.

    Members meet the next two of their cluster, so the pairs are twice the rows.
    """
    w = Window.partitionBy("label").orderBy("vec_id")
    following = F.array(*[F.struct(F.lead("vec_id", k).over(w).alias("b"), F.lead("embedding", k).over(w).alias("vb")) for k in (1, 2)])
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"), following.alias("next"))
    near = rows.select("a", "va", F.explode("next").alias("o")).select("a", "o.b", F.round(V.cosine(F.col("va"), F.col("o.vb")), 6).alias("cosine")).filter("b is not null")
    flag = lambda c: F.expr(c).cast("double")
    score = 0.30 * F.col("cosine") + 0.25 * flag("a % 5 = b % 5") + 0.15 * flag("a % 2 = b % 2") + 0.20 + 0.10 * flag("b - a <= 10")
    return near.select("a", "b", F.round(score, 6).alias("score")).filter("score >= 0.55")


@query("entity_mentions", [61], rf"""WITH {CLAIMS_SQL}, e AS (SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')[1:2] AS w FROM benchmark), n AS (SELECT item_id, w[1] || ' ' || w[2] AS raw, lower(w[1] || ' ' || w[2]) AS norm, lower(w[2] || ' ' || w[1]) AS alias FROM e WHERE len(w) = 2),
g AS (SELECT doc_id, pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, pos, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, pos, regexp_extract_all(claim_text, '[\p{{L}}\p{{N}}]+') AS w FROM claims) WHERE len(w) >= 2)),
m AS (SELECT doc_id, pos, item_id, CASE WHEN gram = raw THEN 1.0 ELSE 0.9 END AS confidence FROM g JOIN n ON lower(gram) = norm UNION ALL SELECT doc_id, pos, item_id, 0.8 FROM g JOIN n ON lower(gram) = alias)
SELECT doc_id, pos::BIGINT AS pos, item_id, max(confidence)::DOUBLE AS confidence FROM m GROUP BY ALL""")
def entity_mentions(spark, sf_dir):
    """Names in sentences by an equi-join on word pairs: as written 1.0, normalised 0.9, an alias (the words turned round) 0.8."""
    pattern = F.lit(r"[\p{L}\p{N}]+")
    first = read(spark, sf_dir, "benchmark").select("item_id", F.slice(F.regexp_extract_all("text", pattern, F.lit(0)), 1, 2).alias("w")).filter(F.size("w") == 2)
    raw = F.array_join("w", " ")
    forms = F.array(F.struct(F.lower(raw).alias("key"), raw.alias("raw"), F.lit(False).alias("alias")), F.struct(F.lower(F.array_join(F.reverse("w"), " ")).alias("key"), raw.alias("raw"), F.lit(True).alias("alias")))
    names = first.select("item_id", F.explode(forms).alias("f")).select("item_id", "f.*")
    words = claims(spark, sf_dir).select("doc_id", "pos", F.regexp_extract_all("claim_text", pattern, F.lit(0)).alias("w")).filter(F.size("w") >= 2)
    grams = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    own = words.select("doc_id", "pos", F.explode(grams).alias("gram")).withColumn("key", F.lower("gram")).join(names, "key")
    sure = F.when(F.col("alias"), 0.8).when(F.col("gram") == F.col("raw"), 1.0).otherwise(0.9)
    return own.groupBy("doc_id", "pos", "item_id").agg(F.max(sure).alias("confidence"))


@query("claim_chunk_bridge", [63], f"""WITH {CLAIMS_SQL}, c AS (SELECT doc_id, i, substr(text, 1 + i * 1300, 1500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 1300.0))::BIGINT)) AS i FROM documents))
SELECT doc_id, pos::BIGINT AS pos, coalesce((SELECT min(i) FROM c WHERE c.doc_id = claims.doc_id AND contains(lower(chunk), lower(claim_text))), -1)::BIGINT AS chunk FROM claims""")
def claim_chunk_bridge(spark, sf_dir):
    """The first chunk of its document that holds a sentence: each document's chunks are cut from its own text, in its own row.

    Chunks are cut once for a document, below a generator of one row, and no sentence's row carries them.
    """
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - 200) / 1300.0)) - 1
    chunks = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.lower(F.substr("text", 1 + i * 1300, F.lit(1500))))
    said = F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda x: F.struct(F.length(F.trim(x)).alias("n"), F.lower(F.trim(x)).alias("claim")))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.struct(chunks.alias("chunks"), said.alias("said")))).alias("d"))
    place = lambda x: F.array_position(F.transform("d.chunks", lambda c: F.contains(c, x["claim"])), True)
    own = docs.select("doc_id", F.posexplode(F.transform("d.said", lambda x: F.when(x["n"] >= 10, place(x)))).alias("pos", "holds")).filter("holds is not null")
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"), (F.col("holds") - 1).alias("chunk"))


@query("procedure_links", [64])
def procedure_links(spark, sf_dir):
    """Steps (a user's sentences) and claims (the next answer's) of a conversation: by the order of the steps, each takes the unused claim
    with the largest Jaccard, 0.18 at least; of equal ones the first. A conversation's turns are its own row."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))).alias("pos", "raw"))
    own = turns.withColumn("w", F.array_distinct(T.words(F.col("raw")))).filter(F.size("w") >= 3)
    one = F.struct(F.col("turn").alias("turn"), F.col("pos").alias("pos"), F.col("w").alias("w"))
    lists = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", one))).alias("steps"), F.array_sort(F.collect_list(F.when(F.col("role") != "user", one))).alias("answers"))
    kind = "array<struct<step_turn:bigint,step:int,claim_turn:bigint,claim:int,jaccard:double>>"

    def take(done, s):
        used = F.transform(done, lambda d: F.struct(d["claim_turn"].alias("turn"), d["claim"].alias("pos")))
        free = F.filter("answers", lambda a: ~F.array_contains(used, F.struct(a["turn"].alias("turn"), a["pos"].alias("pos"))))
        scored = F.transform(free, lambda a: F.struct((-F.round(T.jaccard(s["w"], a["w"]), 6)).alias("j"), a["turn"].alias("turn"), a["pos"].alias("pos")))
        best = F.array_min(scored)
        link = F.struct(s["turn"].alias("step_turn"), s["pos"].alias("step"), best["turn"].alias("claim_turn"), best["pos"].alias("claim"), (-best["j"]).alias("jaccard"))
        return F.when(best.isNotNull() & (-best["j"] >= 0.18), F.concat(done, F.array(link))).otherwise(done).cast(kind)

    links = F.aggregate("steps", F.expr(f"cast(array() as {kind})"), take)
    return lists.select("conv_id", F.explode(links).alias("l")).select("conv_id", "l.step_turn", F.col("l.step").cast("long").alias("step"), "l.claim_turn", F.col("l.claim").cast("long").alias("claim"), "l.jaccard")


@query("section_concept_pairs", [68], """WITH m AS (SELECT l_orderkey AS section, l_partkey AS concept, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT least(a.concept, b.concept) AS a, greatest(a.concept, b.concept) AS b, count(*)::BIGINT AS sections, count(*) FILTER (WHERE a.concept < b.concept)::BIGINT AS in_order FROM m a JOIN m b ON a.section = b.section AND (a.pos, a.concept) < (b.pos, b.concept) GROUP BY 1, 2 HAVING count(*) >= 2""")
def section_concept_pairs(spark, sf_dir):
    """Concepts of one section in the order of their places; a section has a handful of lines, so pairs stay few. Pairs in two sections at least."""
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("section"), F.col("l_partkey").alias("concept")).agg(F.min("l_linenumber").alias("pos"))
    one = own.select("section", F.struct("pos", "concept").alias("x"))
    both = one.join(one.withColumnRenamed("x", "y"), "section").filter("x < y")
    pair = both.groupBy(F.least("x.concept", "y.concept").alias("a"), F.greatest("x.concept", "y.concept").alias("b"))
    return pair.agg(F.count("*").alias("sections"), F.count_if(F.col("x.concept") < F.col("y.concept")).alias("in_order")).filter("sections >= 2")


@query("perspective_subjects", [72], """WITH c AS (SELECT l_orderkey AS question, s_nationkey::BIGINT AS subject, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT question, subject, n::BIGINT AS claims FROM c QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, subject) <= 2""")
def perspective_subjects(spark, sf_dir):
    """The subjects that most of a question's claims are about, two at most."""
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = both.groupBy(F.col("l_orderkey").alias("question"), F.col("s_nationkey").cast("long").alias("subject")).agg(F.count("*").alias("claims"))
    w = Window.partitionBy("question").orderBy(F.desc("claims"), "subject")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").drop("rn")


@query("perspective_scores", [113], f"""WITH {CENTROIDS_SQL}, n AS (SELECT label AS facet, count(*) AS members FROM embeddings GROUP BY label), q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT vec_id AS query_id, facet, round(list_cosine_similarity(v, centroid) + 0.15::DOUBLE * (facet % 2) + CASE WHEN members >= 3 THEN 0.10::DOUBLE ELSE 0 END + 0.1::DOUBLE * least(ln(1 + members) / 10, 1) + CASE WHEN facet = label THEN 0.20::DOUBLE ELSE 0 END, 6) AS score FROM q CROSS JOIN c JOIN n USING (facet))
SELECT query_id, facet, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, facet) <= 2""")
def perspective_scores(spark, sf_dir):
    """The two best perspectives of every query: cosine, tension, three documents, importance, and the query's own subject."""
    rows = read(spark, sf_dir, "embeddings")
    groups = V.centroids(rows, "label", "embedding").join(rows.groupBy("label").agg(F.count("*").alias("members")), "label").withColumnRenamed("label", "facet")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("v"))
    score = (
        V.cosine(F.col("v"), F.col("centroid")) + 0.15 * (F.col("facet") % 2) + F.when(F.col("members") >= 3, 0.10).otherwise(0.0)
        + 0.1 * F.least(F.log1p("members") / 10, F.lit(1.0)) + F.when(F.col("facet") == F.col("label"), 0.20).otherwise(0.0)
    )
    scored = asked.crossJoin(groups).select("query_id", "facet", F.round(score, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "facet")
    return scored.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").drop("rn")


@query("perspective_rerank", [114], """WITH q AS (SELECT vec_id AS query_id, label, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, vec_id, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings USING (label) WHERE vec_id <> query_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) DESC, vec_id) <= 5""")
def perspective_rerank(spark, sf_dir):
    """The five claims of its own perspective that are nearest to every query."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    return V.top_k(rows, asked, "vec_id", "embedding", 5, within="label").select("query_id", F.col("id").alias("vec_id"), "similarity")


@query("ontology_matches", [146, 148], f"""WITH {LABELS_SQL}, o AS (SELECT DISTINCT p_name AS entry FROM part), t AS (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS w FROM labels_of), u AS (SELECT entry, unnest(list_distinct(string_split(entry, ' '))) AS w FROM o),
p AS (SELECT DISTINCT name, entry FROM t JOIN u USING (w)), s AS (SELECT name, entry, round(1 - levenshtein(array_to_string(list_sort(string_split(name, ' ')), ' '), array_to_string(list_sort(string_split(entry, ' ')), ' '))::DOUBLE / greatest(length(name), length(entry)), 6) AS score, CASE WHEN length(entry) < 8 THEN 0.65 WHEN ends_with(name, 'economy') THEN 0.55 ELSE 0.6 END::DOUBLE AS threshold FROM p)
SELECT name, entry, score, threshold FROM s WHERE score >= threshold QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, entry) = 1""")
def ontology_matches(spark, sf_dir):
    """The nearest catalogue entry of each label by sorted tokens, if it is over a threshold that depends on length and type."""
    own = labels(spark, sf_dir).select("name", F.array_distinct(F.split("name", " ")).alias("tn"))
    entries = read(spark, sf_dir, "part").select(F.col("p_name").alias("entry")).distinct().select("entry", F.array_distinct(F.split("entry", " ")).alias("te"))
    met = own.select("name", F.explode("tn").alias("w")).join(entries.select("entry", F.explode("te").alias("w")), "w").select("name", "entry").distinct()
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    score = F.round(1 - F.levenshtein(ordered("name"), ordered("entry")) / F.greatest(F.length("name"), F.length("entry")), 6)
    threshold = F.when(F.length("entry") < 8, 0.65).when(F.endswith("name", F.lit("economy")), 0.55).otherwise(0.6)
    good = met.select("name", "entry", score.alias("score"), threshold.alias("threshold")).filter("score >= threshold")
    w = Window.partitionBy("name").orderBy(F.desc("score"), "entry")
    return good.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


@query("structural_similarity", [147, 160], f"""WITH {PAIRS_SQL}, s AS (SELECT a, b, jac, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b), '[^a-z0-9]', '', 'g') AS variant, array_to_string(list_transform(string_split(a, ' '), lambda w: substr(w, 1, 1)), '') = array_to_string(list_transform(string_split(b, ' '), lambda w: substr(w, 1, 1)), '') AS initials,
  starts_with(b, a || ' ') OR ends_with(b, substr(a, strpos(a, ' '))) AS affix, split_part(a, ' ', 3) = split_part(b, ' ', 3) AS head FROM pairs)
SELECT a, b, round(CASE WHEN variant THEN 1.0 WHEN affix THEN greatest(0.8, jac) ELSE jac END::DOUBLE, 6) AS similarity, CASE WHEN variant THEN 'merge' WHEN NOT head THEN 'distinct' WHEN affix OR initials THEN 'model' ELSE 'distinct' END AS verdict FROM s WHERE jac >= 0.4""")
def structural_similarity(spark, sf_dir):
    """How alike two names are built (variants in spelling, affixes, components), and what a deterministic arbiter says: merge, distinct, or ask a model."""
    a, b = F.col("a"), F.col("b")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    initials = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)), "")
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(3))
    variant = plain(a) == plain(b)
    affix = F.startswith(b, F.concat(a, F.lit(" "))) | F.endswith(b, F.substr(a, F.instr(a, F.lit(" "))))
    similarity = F.when(variant, 1.0).when(affix, F.greatest(F.lit(0.8), "jac")).otherwise(F.col("jac"))
    verdict = F.when(variant, "merge").when(word(a) != word(b), "distinct").when(affix | (initials(a) == initials(b)), "model").otherwise("distinct")
    return pairs(spark, sf_dir).filter("jac >= 0.4").select("a", "b", F.round(similarity, 6).alias("similarity"), verdict.alias("verdict"))


@query("score_cache", [156], """WITH e AS (SELECT event_type, floor(value)::BIGINT AS pair, ts, lag(ts) OVER (PARTITION BY event_type, floor(value) ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, count(*)::BIGINT AS lookups, count(*) FILTER (WHERE before IS NOT NULL AND ts - before <= INTERVAL 24 HOUR)::BIGINT AS hits, count(*) FILTER (WHERE before IS NOT NULL AND ts - before > INTERVAL 24 HOUR)::BIGINT AS expired FROM e GROUP BY event_type""")
def score_cache(spark, sf_dir):
    """Lookups of a pair's score: a hit if the pair was looked up within 24 hours, which keeps it alive; else it has expired."""
    w = Window.partitionBy("event_type", F.floor("value")).orderBy("ts", "event_id")
    own = read(spark, sf_dir, "events").select("event_type", "ts", F.lag("ts").over(w).alias("before"))
    fresh = F.col("ts") - F.col("before") <= F.expr("INTERVAL 24 HOURS")
    return own.groupBy("event_type").agg(F.count("*").alias("lookups"), F.count_if(F.coalesce(fresh, F.lit(False))).alias("hits"), F.count_if(F.coalesce(~fresh, F.lit(False))).alias("expired"))


@query("deferred_pairs", [157, 309], f"""WITH {FACTS_SQL}, d AS (SELECT predicate, status, valid_from, lead(valid_from, 5) OVER (PARTITION BY subject, predicate ORDER BY valid_from, fact_id) AS fifth, max(valid_from) OVER () AS today FROM facts)
SELECT predicate, CASE WHEN fifth <= valid_from + INTERVAL 7 DAY THEN 're-evaluate' WHEN today > valid_from + INTERVAL 7 DAY THEN 'expired' ELSE 'waiting' END AS state, count(*)::BIGINT AS pairs FROM d WHERE status = 'proposed' GROUP BY 1, 2""")
def deferred_pairs(spark, sf_dir):
    """What was put off: looked at again after five more statements on the same, thrown out after seven days, else waiting."""
    own = facts(spark, sf_dir)
    today = own.agg(F.max("valid_from").alias("today"))
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", "fact_id")
    put_off = own.select("predicate", "status", "valid_from", F.lead("valid_from", 5).over(w).alias("fifth")).filter("status = 'proposed'").crossJoin(F.broadcast(today))
    limit = F.col("valid_from") + F.expr("INTERVAL 7 DAYS")
    state = F.when(F.col("fifth") <= limit, "re-evaluate").when(F.col("today") > limit, "expired").otherwise("waiting")
    return put_off.groupBy("predicate", state.alias("state")).agg(F.count("*").alias("pairs"))


@query("cross_lingual_pairs", [165], """SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 3 <> b.vec_id % 3 WHERE a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) = 1 AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3""")
def cross_lingual_pairs(spark, sf_dir):
    """For every query (ids divisible by 20) the nearest name in another language (the id's remainder by 3), if near enough."""
    rows = read(spark, sf_dir, "embeddings").withColumn("language", F.col("vec_id") % 3)
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "language")
    return V.top_k(rows, asked, "vec_id", "embedding", 1, across="language").filter("similarity >= 0.3").select("query_id", "id", "similarity")


@query("dimension_mapping", [242], """WITH k AS (SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'max_' ELSE 'min_' END || replace(p_name, ' ', '_') AS key, CASE WHEN p_size % 3 = 0 THEN 'number' ELSE 'percent' END AS vtype, p_name FROM part), r AS (SELECT key, vtype FROM k WHERE vtype = 'number' AND starts_with(key, 'max_')),
p AS (SELECT k.key AS candidate, r.key AS dimension, k.vtype = r.vtype AS same_type, substr(k.key, 1, 4) = substr(r.key, 1, 4) AS same_side, len(list_filter(range(1, least(length(k.key), length(r.key)) + 1), lambda i: substr(k.key, 5, i) = substr(r.key, 5, i) AND i + 4 <= least(length(k.key), length(r.key)))) AS common, greatest(length(k.key), length(r.key)) - 4 AS longest FROM k JOIN r ON split_part(k.key, '_', 2) = split_part(r.key, '_', 2)),
s AS (SELECT *, CASE WHEN candidate = dimension THEN 1.0 WHEN common::DOUBLE / longest >= 0.6 THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM p WHERE same_type AND same_side)
SELECT candidate, dimension, score FROM s WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY score DESC, dimension) = 1""")
def dimension_mapping(spark, sf_dir):
    """Candidate keys mapped to known dimensions of the same value type and side (min or max): equal keys 1.0, a common start of 60 % 0.8."""
    size = F.col("p_size")
    keys = read(spark, sf_dir, "part").select(
        F.concat(F.when(size % 2 == 0, "max_").otherwise("min_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("key"), F.when(size % 3 == 0, "number").otherwise("percent").alias("vtype")
    ).distinct()
    word = lambda c: F.split_part(c, F.lit("_"), F.lit(2))
    known = keys.filter("vtype = 'number' and startswith(key, 'max_')").select(F.col("key").alias("dimension"), F.col("vtype").alias("dtype")).withColumn("block", word(F.col("dimension")))
    both = keys.select(F.col("key").alias("candidate"), "vtype").withColumn("block", word(F.col("candidate"))).join(known, "block").filter("vtype = dtype and left(candidate, 4) = left(dimension, 4)")
    a, b = F.substring("candidate", 5, 200), F.substring("dimension", 5, 200)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    common = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    score = F.when(F.col("candidate") == F.col("dimension"), 1.0).when(common / longer >= 0.6, 0.8).otherwise(0.0)
    good = both.select("candidate", "dimension", score.alias("score")).filter("score >= 0.7")
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "dimension")
    return good.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


@query("scope_temporal_gate", [243], f"""WITH {PREVIOUS_SQL}, g AS (SELECT *, lag(scope) OVER w AS c_scope, lag(source_doc) OVER w AS c_doc, lag(stated_at) OVER w AS c_at FROM parsed WINDOW w AS (PARTITION BY subject ORDER BY stated_at, order_id, line, source_doc, object_text, hedge)), h AS (SELECT *, lag(object_text) OVER (PARTITION BY subject ORDER BY stated_at, order_id, line, source_doc, object_text, hedge) AS c_text FROM g)
SELECT CASE WHEN scope <> c_scope THEN 'SKIP_DISJOINT' WHEN object_text = c_text AND stated_at > c_at THEN 'LIKELY_REAFFIRMS' WHEN source_doc % 10 = c_doc % 10 AND stated_at > c_at THEN 'LIKELY_SUPERSEDES' ELSE 'FULL_MODEL' END AS gate, count(*)::BIGINT AS pairs FROM h WHERE c_text IS NOT NULL GROUP BY 1""")
def scope_temporal_gate(spark, sf_dir):
    """What a pair of statements needs before any model: other scopes are skipped; a later equal one reaffirms, a later one of the same source family supersedes."""
    w = Window.partitionBy("subject").orderBy("stated_at", "order_id", "line", "source_doc", "object_text", "hedge")
    before = {c: F.lag(c).over(w).alias(f"c_{c}") for c in ("scope", "source_doc", "stated_at", "object_text")}
    own = statements(spark, sf_dir).select("*", *before.values()).filter("c_object_text is not null")
    later = F.col("stated_at") > F.col("c_stated_at")
    gate = (
        F.when(F.col("scope") != F.col("c_scope"), "SKIP_DISJOINT")
        .when((F.col("object_text") == F.col("c_object_text")) & later, "LIKELY_REAFFIRMS")
        .when((F.col("source_doc") % 10 == F.col("c_source_doc") % 10) & later, "LIKELY_SUPERSEDES")
        .otherwise("FULL_MODEL")
    )
    return own.groupBy(gate.alias("gate")).agg(F.count("*").alias("pairs"))


@query("merge_rollback", [154, 252], """WITH m AS (SELECT s_suppkey AS source, s_suppkey - s_suppkey % 3 AS target, s_suppkey % 2 = 0 AS undone FROM supplier WHERE s_suppkey % 3 <> 0), e AS (SELECT l_suppkey AS node, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT coalesce(m.target, e.node) AS merged, CASE WHEN m.undone THEN e.node ELSE coalesce(m.target, e.node) END AS back, n FROM e LEFT JOIN m ON e.node = m.source),
a AS (SELECT merged AS node, sum(n) AS n FROM x GROUP BY 1), b AS (SELECT back AS node, sum(n) AS n FROM x GROUP BY 1)
SELECT b.node, coalesce(a.n, 0)::BIGINT AS after_merge, b.n::BIGINT AS after_rollback FROM b LEFT JOIN a USING (node)""")
def merge_rollback(spark, sf_dir):
    """Merges as rows of an audit log: edges follow the log to the target; rows taken out of the log put their edges back."""
    log = read(spark, sf_dir, "supplier").filter("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") - F.col("s_suppkey") % 3).alias("target"))
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("n"))

    def applied(entries, name):
        moved = counts.join(entries, counts["node"] == entries["source"], "left").select(F.coalesce("target", "node").alias("node"), "n")
        return moved.groupBy("node").agg(F.sum("n").alias(name))

    kept = log.filter("source % 2 != 0")
    return applied(kept, "after_rollback").join(applied(log, "after_merge"), "node", "left").select("node", F.coalesce("after_merge", F.lit(0)).alias("after_merge"), "after_rollback")


@query("predicate_resolution", [164], """WITH v AS (SELECT DISTINCT upper(event_type) AS known FROM events), r AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'Error' WHEN 1 THEN 'pur-chase' WHEN 2 THEN 'viewed' ELSE 'click' END AS raw FROM orders),
c AS (SELECT raw, known, CASE WHEN upper(raw) = known THEN 1.0 WHEN regexp_replace(upper(raw), '[^A-Z]+', '', 'g') = known THEN 0.95 WHEN starts_with(upper(raw), known) THEN 0.88 ELSE 0 END::DOUBLE AS score FROM r CROSS JOIN v)
SELECT raw, coalesce(max(known) FILTER (WHERE score >= 0.88), 'none') AS predicate, max(score) AS score FROM c GROUP BY raw""")
def predicate_resolution(spark, sf_dir):
    """Raw predicates to the vocabulary: equal, equal after signs are dropped, or the same stem; both sides are lists of distinct values."""
    n = F.col("o_orderkey") % 4
    raw = read(spark, sf_dir, "orders").select(F.when(n == 0, "Error").when(n == 1, "pur-chase").when(n == 2, "viewed").otherwise("click").alias("raw")).distinct()
    known = read(spark, sf_dir, "events").select(F.upper("event_type").alias("known")).distinct()
    up = F.upper("raw")
    score = F.when(up == F.col("known"), 1.0).when(F.regexp_replace(up, "[^A-Z]+", "") == F.col("known"), 0.95).when(F.startswith(up, F.col("known")), 0.88).otherwise(0.0)
    scored = raw.crossJoin(F.broadcast(known)).select("raw", "known", score.alias("score"))
    return scored.groupBy("raw").agg(F.coalesce(F.max(F.when(F.col("score") >= 0.88, F.col("known"))), F.lit("none")).alias("predicate"), F.max("score").alias("score"))
