"""Answers and their evidence: modes, scopes, checks against a corpus, references in conversations, scores of answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import values as VAL
from ..operators import vectors as V
from ..operators.graph import cut
from ..sources.statements import STATEMENTS_SQL, statements
from ..sources.tables import read
from .language import IDS_SQL, document_ids
from .registry import query
from .values import PARSED_SQL


@query("evidence_modes", [283], """WITH e AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'single' WHEN '2' THEN 'exhaustive' WHEN '3' THEN 'comparative' ELSE 'chronological' END AS mode, l_partkey, l_suppkey % 3 AS doc, l_quantity AS score, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, l_partkey, l_shipdate, doc) AS best, row_number() OVER (PARTITION BY o_orderkey, doc ORDER BY score DESC, l_partkey, l_shipdate) AS of_doc, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_partkey, score, doc) AS early FROM e)
SELECT o_orderkey, mode, count(*)::BIGINT AS pieces, sum(l_partkey)::BIGINT AS parts FROM r WHERE (mode = 'single' AND best = 1) OR mode = 'exhaustive' OR (mode = 'comparative' AND of_doc = 1) OR (mode = 'chronological' AND early <= 2) GROUP BY ALL""")
def evidence_modes(spark, sf_dir):
    """What a question collects: the best piece, all, the best of each document, or the earliest two.

    A question has one mode, so its pieces need one order only: by date or by
    score. Pieces that are equal in it have the same part.
    """
    letter = F.left("o_orderpriority", F.lit(1))
    mode = F.when(letter == "1", "single").when(letter == "2", "exhaustive").when(letter == "3", "comparative").otherwise("chronological")
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey"), mode.alias("mode"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", (F.col("l_suppkey") % 3).alias("doc"), F.col("l_quantity").alias("score"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"))
    of_doc = F.when(F.col("mode") == "comparative", F.col("doc"))
    early = F.when(F.col("mode") == "chronological", F.col("at"))
    pieces = asked.join(lines, "o_orderkey").select("o_orderkey", "mode", "l_partkey", of_doc.alias("doc"), early.alias("early"), F.when(F.col("mode") != "chronological", -F.col("score")).alias("low"))
    order = Window.partitionBy("o_orderkey", "doc").orderBy(F.asc_nulls_last("early"), F.asc_nulls_last("low"), F.asc_nulls_last("l_partkey"))
    most = F.when(F.col("mode") == "chronological", 2).otherwise(1)
    kept = pieces.withColumn("place", F.row_number().over(order)).filter((F.col("mode") == "exhaustive") | (F.col("place") <= most))
    return kept.groupBy("o_orderkey", "mode").agg(F.count("*").alias("pieces"), F.sum("l_partkey").alias("parts"))


SIGNALS_SQL = f"""{PARSED_SQL}, g AS (SELECT subject, count(*) AS n, count(DISTINCT object_text) FILTER (WHERE kind = 'version') AS versions, count(DISTINCT object_text) FILTER (WHERE kind = 'boolean') AS flags, count(DISTINCT object_text) FILTER (WHERE kind = 'scalar') AS scalars, count(DISTINCT source_doc) AS docs, count(DISTINCT scope) AS scopes, max(stated_at) AS newest, count(*) FILTER (WHERE authority = 'HIGH') AS sure FROM parsed GROUP BY subject)"""


def signals(spark, sf_dir):
    """For each part, what its statements show together."""
    kind = VAL.kind_of(F.col("object_text"))
    of = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("object_text")))
    own = statements(spark, sf_dir).withColumn("kind", kind).groupBy("subject")
    return own.agg(
        F.count("*").alias("n"), of("version").alias("versions"), of("boolean").alias("flags"), of("scalar").alias("scalars"), F.countDistinct("source_doc").alias("docs"),
        F.countDistinct("scope").alias("scopes"), F.max("stated_at").alias("newest"), F.count_if(F.col("authority") == "HIGH").alias("sure"),
    )


@query("response_modes", [285], f"""WITH {SIGNALS_SQL} SELECT subject, flags > 1 AS tension, versions > 1 AS evolution, n < 5 OR docs < 3 AS gap, CASE WHEN n < 5 OR docs < 3 THEN 'partial' WHEN flags > 1 AND versions > 3 THEN 'tension' WHEN versions > 3 THEN 'evolution' WHEN scalars = 1 THEN 'exact' ELSE 'direct' END AS mode FROM g""")
def response_modes(spark, sf_dir):
    """Signals of a subject's claims (tension, evolution, coverage gap) and the mode in which to answer."""
    own = signals(spark, sf_dir)
    gap = (F.col("n") < 5) | (F.col("docs") < 3)
    mode = F.when(gap, "partial").when((F.col("flags") > 1) & (F.col("versions") > 3), "tension").when(F.col("versions") > 3, "evolution").when(F.col("scalars") == 1, "exact").otherwise("direct")
    return own.select("subject", (F.col("flags") > 1).alias("tension"), (F.col("versions") > 1).alias("evolution"), gap.alias("gap"), mode.alias("mode"))


@query("uncertainty_signals", [289], f"""WITH {SIGNALS_SQL} SELECT subject, CASE WHEN flags > 1 AND sure = 0 THEN 'review' WHEN flags > 1 THEN 'contradicting' WHEN newest < TIMESTAMP '2001-06-01' THEN 'older only' WHEN versions > 1 THEN 'replaced' ELSE 'clear' END AS signal, CASE WHEN flags > 1 AND sure = 0 THEN 'escalate' WHEN flags > 1 THEN 'show both' WHEN newest < TIMESTAMP '2001-06-01' THEN 'verify date' WHEN versions > 1 THEN 'use newest' ELSE 'answer' END AS recommendation FROM g""")
def uncertainty_signals(spark, sf_dir):
    """Why an answer about a subject may be unsure, and what to do about it."""
    torn, old = F.col("flags") > 1, F.col("newest") < F.lit("2001-06-01 00:00:00").cast("timestamp_ntz")
    pick = lambda a, b, c, d, e: F.when(torn & (F.col("sure") == 0), a).when(torn, b).when(old, c).when(F.col("versions") > 1, d).otherwise(e)
    return signals(spark, sf_dir).select("subject", pick("review", "contradicting", "older only", "replaced", "clear").alias("signal"), pick("escalate", "show both", "verify date", "use newest", "answer").alias("recommendation"))


@query("scoped_answers", [290], f"""WITH {STATEMENTS_SQL}, c AS (SELECT subject, scope, count(*) AS n FROM statements GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY subject) AS total, row_number() OVER (PARTITION BY subject ORDER BY n DESC, scope) AS rn FROM c)
SELECT subject, scope, round(n::DOUBLE / total, 6) AS share, CASE WHEN n = total THEN 'answer' WHEN n >= 0.5 * total THEN 'answer with scope' ELSE 'ask' END AS action FROM r WHERE rn = 1""")
def scoped_answers(spark, sf_dir):
    """The scope in which a question about a subject is answered: the only one, the leading one, or ask which is meant."""
    counts = statements(spark, sf_dir).groupBy("subject", "scope").agg(F.count("*").alias("n"))
    w = Window.partitionBy("subject")
    own = counts.select("*", F.sum("n").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("n"), "scope")).alias("rn")).filter("rn = 1")
    action = F.when(F.col("n") == F.col("total"), "answer").when(F.col("n") >= 0.5 * F.col("total"), "answer with scope").otherwise("ask")
    return own.select("subject", "scope", F.round(F.col("n") / F.col("total"), 6).alias("share"), action.alias("action"))


@query("statement_validation", [291], f"""WITH {PARSED_SQL}, known AS (SELECT subject, kind, count(DISTINCT object_text) AS answers, min(object_text) AS answer FROM parsed WHERE stated_at < TIMESTAMP '2000-01-01' GROUP BY ALL), exact AS (SELECT DISTINCT subject, object_text FROM parsed WHERE stated_at < TIMESTAMP '2000-01-01'), asked AS (SELECT subject, kind, object_text, count(*) AS times FROM parsed WHERE stated_at >= TIMESTAMP '2000-01-01' GROUP BY ALL)
SELECT CASE WHEN k.subject IS NULL THEN 'NOT_DOCUMENTED' WHEN x.subject IS NOT NULL AND answers = 1 THEN 'CONFIRMED' WHEN x.subject IS NOT NULL THEN 'UNCERTAIN' WHEN answers = 1 THEN 'INCORRECT' ELSE 'UNCERTAIN' END AS status, a.kind, count(*)::BIGINT AS statements, sum(times)::BIGINT AS times
FROM asked a LEFT JOIN known k ON a.subject = k.subject AND a.kind = k.kind LEFT JOIN exact x ON a.subject = x.subject AND a.object_text = x.object_text GROUP BY 1, 2""")
def statement_validation(spark, sf_dir):
    """Newer statements against what the older corpus says on the same question: one answer confirms or refutes, several leave it open."""
    own = statements(spark, sf_dir).withColumn("kind", VAL.kind_of(F.col("object_text")))
    since = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    old = own.filter(F.col("stated_at") < since)
    known = old.groupBy("subject", "kind").agg(F.countDistinct("object_text").alias("answers"))
    exact = old.select("subject", "object_text").distinct().withColumn("said", F.lit(True))
    asked = own.filter(F.col("stated_at") >= since).groupBy("subject", "kind", "object_text").agg(F.count("*").alias("times"))
    both = asked.join(known, ["subject", "kind"], "left").join(exact, ["subject", "object_text"], "left")
    one, said = F.col("answers") == 1, F.col("said").isNotNull()
    status = F.when(F.col("answers").isNull(), "NOT_DOCUMENTED").when(said & one, "CONFIRMED").when(said, "UNCERTAIN").when(one, "INCORRECT").otherwise("UNCERTAIN")
    return both.groupBy(status.alias("status"), "kind").agg(F.count("*").alias("statements"), F.sum("times").alias("times"))


@query("answer_level_checks", [288], f"""WITH {PARSED_SQL}, s AS (SELECT order_id, kind, source_doc, n[1] AS v, object_text FROM parsed), d AS (SELECT order_id, max(v) - min(v) > 0.1 * max(v) AND count(DISTINCT source_doc) > 1 AS diverging FROM s WHERE kind = 'scalar' GROUP BY order_id), m AS (SELECT order_id, bool_or(n > 1) AS mixed FROM (SELECT order_id, source_doc % 5 AS doc, count(DISTINCT object_text) AS n FROM s WHERE kind = 'version' GROUP BY ALL) GROUP BY order_id),
o AS (SELECT DISTINCT order_id FROM s) SELECT o.order_id, coalesce(diverging, false) AS diverging, coalesce(mixed, false) AS mixed_versions FROM o LEFT JOIN d USING (order_id) LEFT JOIN m USING (order_id) WHERE coalesce(diverging, false) OR coalesce(mixed, false)""")
def answer_level_checks(spark, sf_dir):
    """Answers (orders) whose numbers from different sources differ by over a tenth, or that mix versions of one document."""
    own = statements(spark, sf_dir).select("order_id", "source_doc", "object_text", VAL.parse(F.col("object_text")).alias("v"))
    low = F.when(F.col("v.kind") == "scalar", F.col("v.low"))
    source = F.when(low.isNotNull(), F.col("source_doc"))
    version = F.when(F.col("v.kind") == "version", F.col("object_text"))
    # more than one of something: its least is not its largest
    docs = own.groupBy("order_id", (F.col("source_doc") % 5).alias("doc")).agg(
        F.max(low).alias("high"), F.min(low).alias("low"), F.min(source).alias("first"), F.max(source).alias("last"), (F.min(version) != F.max(version)).alias("mixed")
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    diverging = (F.max("high") - F.min("low") > 0.1 * F.max("high")) & (F.min("first") != F.max("last"))
    both = docs.groupBy("order_id").agg(no(diverging).alias("diverging"), no(F.bool_or("mixed")).alias("mixed_versions"))
    return both.filter("diverging or mixed_versions")


@query("unsupported_tokens", [287], r"""WITH t AS (SELECT conv_id, turn, role, list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '"[^"]*"', ' ', 'g'), '[\p{L}\p{N}]*[0-9][\p{L}\p{N}]*|[\p{L}]{9,}'), lambda x: lower(x))) AS w FROM conversations), e AS (SELECT a.conv_id, a.turn, list_distinct(flatten(list(b.w))) AS seen FROM (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'assistant') a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY ALL)
SELECT t.conv_id, t.turn, len(w)::BIGINT AS tokens, len(list_filter(w, lambda x: NOT list_contains(coalesce(seen, []), x)))::BIGINT AS unsupported, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: list_contains(coalesce(seen, []), x)))::DOUBLE / len(w) END, 6) AS confidence FROM t LEFT JOIN e ON t.conv_id = e.conv_id AND t.turn = e.turn WHERE role = 'assistant'""")
def unsupported_tokens(spark, sf_dir):
    """Factual tokens of an answer, outside quotes, that the conversation so far does not have."""
    pattern = F.lit(r"[\p{L}\p{N}]*[0-9][\p{L}\p{N}]*|[\p{L}]{9,}")
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace("text", '"[^"]*"', " "), pattern, F.lit(0)), lambda x: F.lower(x)))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens.alias("w"))
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = turns.withColumn("seen", F.flatten(F.collect_list("w").over(before))).filter("role = 'assistant'")
    missing = F.size(F.array_except("w", F.coalesce("seen", F.array().cast("array<string>"))))
    share = F.when(F.size("w") == 0, 1.0).otherwise(1 - missing / F.size("w"))
    return own.select("conv_id", "turn", F.size("w").cast("long").alias("tokens"), missing.cast("long").alias("unsupported"), F.round(share, 6).alias("confidence"))


@query("session_references", [292], r"""WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations), f AS (SELECT conv_id, turn, role, w, list_filter(w, lambda x: length(x) >= 9)[1] AS entity FROM w),
b AS (SELECT *, lag(entity) OVER (PARTITION BY conv_id ORDER BY turn, role) AS last_entity, first_value(entity) OVER (PARTITION BY conv_id ORDER BY turn, role) AS first_entity FROM f)
SELECT conv_id, turn, CASE WHEN len(list_intersect(w[1:6], ['it', 'this', 'that', 'il', 'elle', 'es', 'sie', 'esto'])) > 0 THEN 'pronoun' ELSE 'first' END AS reference, coalesce(CASE WHEN len(list_intersect(w[1:6], ['it', 'this', 'that', 'il', 'elle', 'es', 'sie', 'esto'])) > 0 THEN last_entity ELSE first_entity END, 'unresolved') AS target
FROM b WHERE turn > 0 AND role = 'user' AND (len(list_intersect(w[1:6], ['it', 'this', 'that', 'il', 'elle', 'es', 'sie', 'esto'])) > 0 OR len(list_intersect(w[1:6], ['first', 'the', 'le', 'der', 'el'])) > 0)""")
def session_references(spark, sf_dir):
    """What a user's turn refers back to: a pronoun to the entity of the turn before, an article to the first entity of the conversation."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.words(F.col("text")).alias("w"))
    entity = F.try_element_at(F.filter("w", lambda x: F.length(x) >= 9), F.lit(1))
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    own = turns.withColumn("entity", entity).select("*", F.lag("entity").over(w).alias("last"), F.first("entity").over(w).alias("opening"))
    start = F.slice("w", 1, 6)
    has = lambda words: F.arrays_overlap(start, F.array(*map(F.lit, words)))
    pronoun = has(["it", "this", "that", "il", "elle", "es", "sie", "esto"])
    asked = own.filter((F.col("turn") > 0) & (F.col("role") == "user") & (pronoun | has(["first", "the", "le", "der", "el"])))
    return asked.select("conv_id", "turn", F.when(pronoun, "pronoun").otherwise("first").alias("reference"), F.coalesce(F.when(pronoun, F.col("last")).otherwise(F.col("opening")), F.lit("unresolved")).alias("target"))


@query("conversation_topics", [293], r"""WITH t AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM conversations), c AS (SELECT conv_id, w, count(*) AS n FROM t WHERE length(w) >= 6 GROUP BY ALL)
SELECT conv_id, w AS word, n::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, w) <= 3""")
def conversation_topics(spark, sf_dir):
    """The three longest-lived words of a conversation."""
    words = read(spark, sf_dir, "conversations").select("conv_id", F.explode(T.words(F.col("text"))).alias("word")).filter(F.length("word") >= 6)
    counts = words.groupBy("conv_id", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("n"), "word")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@query("vector_only_answers", [294, 286], """SELECT a.vec_id AS query_id, b.vec_id AS id, b.label AS mode, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) < 0.25 AS abstain FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) = 1""")
def vector_only_answers(spark, sf_dir):
    """The plain baseline: every query takes the nearest row and that row's mode, or abstains where even that is far."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    best = V.top_k(rows, asked, "vec_id", "embedding", 1)
    return best.join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("mode")), "id").select("query_id", "id", "mode", (F.col("similarity") < 0.25).alias("abstain"))


@query("answer_scores", [321, 323], """WITH g AS (SELECT l_orderkey AS q, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag <> 'N')) AS gold, list_distinct(list(l_partkey) FILTER (WHERE l_linestatus = 'F')) AS said FROM lineitem GROUP BY 1),
s AS (SELECT q, coalesce(len(gold), 0) AS g, coalesce(len(said), 0) AS s, coalesce(len(list_intersect(gold, said)), 0) AS hit FROM g)
SELECT substr(o_orderpriority, 3) AS kind, count(*)::BIGINT AS questions, round(sum(hit)::DOUBLE / nullif(sum(g), 0), 6) AS recall, round(sum(hit)::DOUBLE / nullif(sum(s), 0), 6) AS correctness, round(avg(CASE WHEN g = 0 THEN 1.0 ELSE hit::DOUBLE / g END), 6) AS mean_recall FROM s JOIN orders ON q = o_orderkey GROUP BY 1""")
def answer_scores(spark, sf_dir):
    """Recall and correctness of what answers cite against what they should, by kind of question."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("gold"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("said")
    )
    own = lines.select("o_orderkey", F.size("gold").alias("g"), F.size("said").alias("s"), F.size(F.array_intersect("gold", "said")).alias("hit")).join(read(spark, sf_dir, "orders"), "o_orderkey")
    rate = lambda c: F.round(F.sum("hit") / F.nullif(F.sum(c), F.lit(0)), 6)
    mean = F.round(F.avg(F.when(F.col("g") == 0, 1.0).otherwise(F.col("hit") / F.col("g"))), 6)
    return own.groupBy(F.substring("o_orderpriority", 3, 100).alias("kind")).agg(F.count("*").alias("questions"), rate("g").alias("recall"), rate("s").alias("correctness"), mean.alias("mean_recall"))


@query("multi_view_scores", [324], """WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part), s AS (SELECT *, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) AS common, len(list_distinct(string_split(a, ' '))) AS na, len(list_distinct(string_split(b, ' '))) AS nb FROM p WHERE b IS NOT NULL)
SELECT p_partkey, a = b AS exact, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS fuzzy, round(2.0 * common / (na + nb), 6)::DOUBLE AS token_f1 FROM s""")
def multi_view_scores(spark, sf_dir):
    """An answer against the expected one from several views: equal, nearly equal, and by its tokens."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    own = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(w).alias("b")).filter("b is not null")
    x, y = F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))
    f1 = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return own.select("p_partkey", (F.col("a") == F.col("b")).alias("exact"), F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 6).alias("fuzzy"), F.round(f1, 6).alias("token_f1"))


@query("question_anchors", [346], rf"""WITH {IDS_SQL}, d AS (SELECT o_orderkey, unnest(list_distinct(regexp_extract_all(doc_ref, '[0-9]{{2,}}'))) AS anchor FROM ids), q AS (SELECT DISTINCT s_suppkey, unnest([(s_suppkey % 200 + 11)::VARCHAR, (s_suppkey % 3 + 11)::VARCHAR]) AS anchor FROM supplier WHERE s_suppkey % 20 = 0),
m AS (SELECT s_suppkey, o_orderkey, count(*) AS hits FROM q JOIN d USING (anchor) GROUP BY ALL) SELECT s_suppkey AS question, o_orderkey AS doc, hits::BIGINT AS hits FROM m QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY hits DESC, o_orderkey) <= 3""")
def question_anchors(spark, sf_dir):
    """Documents whose ids have a question's structural anchors (numbers), by how many they share; questions are the ids divisible by 20.

    Only anchors that some question has count (203 at most, by the questions' moduli). Documents with the same of these share as many
    with any question, and questions with the same ones find the same: classes meet, not rows, each with its first three documents.
    """
    n = F.col("s_suppkey")
    asked = read(spark, sf_dir, "supplier").filter(n % 20 == 0).select(n.alias("question"), F.array_sort(F.array_distinct(F.array((n % 200 + 11).cast("string"), (n % 3 + 11).cast("string")))).alias("asked")).distinct()
    classes = cut(asked.select("asked").distinct().select("asked", F.explode("asked").alias("anchor")))
    wanted = classes.agg(F.collect_set("anchor").alias("wanted"))
    anchors = F.array_intersect(F.regexp_extract_all("doc_ref", F.lit("[0-9]{2,}"), F.lit(0)), "wanted")
    found = document_ids(spark, sf_dir).crossJoin(F.broadcast(wanted)).select(F.col("o_orderkey").alias("doc"), anchors.alias("anchors")).filter(F.size("anchors") > 0)
    # An id on several rows has the anchors of all of them.
    docs = found.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("anchors"))).alias("of_doc"))
    first = Window.partitionBy("of_doc").orderBy(F.asc_nulls_last("doc"))
    firsts = cut(docs.withColumn("place", F.row_number().over(first)).filter("place <= 3").drop("place"))
    shared = firsts.select("of_doc").distinct().select("of_doc", F.explode("of_doc").alias("anchor")).join(classes, "anchor").groupBy("asked", "of_doc").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("asked").orderBy(F.desc("hits"), F.asc_nulls_last("doc"))
    best = shared.join(firsts, "of_doc").select("asked", "doc", "hits").withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    return asked.join(best, "asked").select("question", "doc", "hits")
