"""Retrieval: BM25, vectors, fusion, containment, gates and reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import lexical
from ..operators import vectors as V
from ..sources.tables import read
from ..sources.views import TOKENS_SQL, tokens
from .registry import query

TERMS = ["the", "license", "copyright", "entre", "und"]
BM25_SQL = f"""{TOKENS_SQL}, c AS (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::DOUBLE AS length FROM c GROUP BY doc_id), s AS (SELECT count(*) AS docs, avg(length) AS mean FROM n),
h AS (SELECT * FROM c WHERE token IN ('the', 'license', 'copyright', 'entre', 'und')), f AS (SELECT token, count(*) AS df FROM h GROUP BY token),
b AS (SELECT h.doc_id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
  FROM h JOIN f USING (token) JOIN n ON h.doc_id = n.doc_id CROSS JOIN s GROUP BY h.doc_id)"""


@query("bm25_search", [278, 276], f"""WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, doc_id LIMIT 50""")
def bm25_search(spark, sf_dir):
    scored = lexical.bm25_of_texts(read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")), "doc_id", "w", TERMS)
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("hybrid_search", [103, 276, 277], f"""WITH {BM25_SQL}, lex AS (
  SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS r FROM b QUALIFY r < 50),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
den AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, vec_id) - 1 AS r FROM embeddings CROSS JOIN q QUALIFY r < 50)
SELECT id, round(1.0::DOUBLE / (60 + coalesce(lex.r, 151)) + 1.0::DOUBLE / (60 + coalesce(den.r, 151)), 8) AS rrf FROM lex FULL JOIN den USING (id)""")
def hybrid_search(spark, sf_dir):
    """Lexical and dense legs of 50 each, fused by reciprocal ranks."""
    k = 50
    scored = lexical.bm25_of_texts(read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")), "doc_id", "w", TERMS)
    lex = lexical.ranked(scored.select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score")), "score", "id", k)
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    near = rows.crossJoin(F.broadcast(asked)).select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    dense = lexical.ranked(near, "score", "id", k)
    return lexical.reciprocal_rank_fusion([lex, dense], "id", k).select("id", F.round("rrf", 8).alias("rrf"))


@query("top_k_per_group", [104], """SELECT source, doc_id, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5""")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("source", "doc_id", "n_chars")


@query("topic_documents", [126], f"""WITH {TOKENS_SQL}, c AS (SELECT doc_id, source, count(*) FILTER (WHERE token IN ('license', 'copyright', 'reserved'))::DOUBLE / count(*) AS share FROM tokens GROUP BY ALL)
SELECT source, count(*)::BIGINT AS docs, round(max(share), 6) AS best FROM c WHERE share > 0 GROUP BY source""")
def topic_documents(spark, sf_dir):
    """Where a topic's words occur: the best share of them in a document, by source."""
    topic = F.col("token").isin("license", "copyright", "reserved")
    own = tokens(spark, sf_dir).groupBy("doc_id", "source").agg((F.count_if(topic) / F.count("*")).alias("share")).filter("share > 0")
    return own.groupBy("source").agg(F.count("*").alias("docs"), F.round(F.max("share"), 6).alias("best"))


def grams(df, id_col: str, text_col: str, n: int, among=None):
    """Each run of n words of the lower-cased texts, with the words joined by a blank, once for each id; among: only those of a table's column gram."""
    words = F.filter(F.split(F.lower(text_col), "[^a-z0-9]+"), lambda w: w != "")
    lists = df.select(F.col(id_col), words.alias("w"))
    spans = lists.filter(F.size("w") >= n).select(id_col, "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    made = spans.select(id_col, F.array_join(F.slice("w", F.col("i"), n), " ").alias("gram"))
    if among is not None:
        made = made.join(among, "gram", "left_semi")
    return made.distinct()


GRAMS_SQL = """SELECT DISTINCT {id}, array_to_string(w[i:i+7], ' ') AS gram FROM (
  SELECT {id}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table}) WHERE len(w) >= 8)"""


@query("quote_containment", [192, 369], f"""WITH d AS ({GRAMS_SQL.format(id='doc_id', table='documents')}), q AS ({GRAMS_SQL.format(id='item_id', table='benchmark')}),
n AS (SELECT item_id, count(*) AS total FROM q GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, round(count(*)::DOUBLE / any_value(total), 6) AS share FROM d JOIN q USING (gram) JOIN n USING (item_id) GROUP BY doc_id, item_id""")
def quote_containment(spark, sf_dir):
    """How much of each quote's eight-word strings a document has: documents' strings that no quote has are left out before they are
    made distinct or travel; the quotes' strings are few, and Spark broadcasts them by their measured size."""
    quotes = G.cut(grams(read(spark, sf_dir, "benchmark"), "item_id", "text", 8))
    totals = quotes.groupBy("item_id").agg(F.count("*").alias("total"))
    wanted = quotes.select("gram").distinct()
    docs = grams(read(spark, sf_dir, "documents"), "doc_id", "text", 8, among=wanted)
    shared = docs.join(quotes, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return shared.join(totals, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("total"), 6).alias("share"))


@query("answer_gap", [284], f"""WITH {TOKENS_SQL}, df AS (SELECT token, count(DISTINCT doc_id) AS df FROM tokens GROUP BY token),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark)
SELECT item_id, count(*)::BIGINT AS terms, count(*) FILTER (WHERE df IS NULL)::BIGINT AS missing,
 CASE WHEN count(*) FILTER (WHERE df IS NULL)::DOUBLE / count(*) >= 0.5 THEN 'unanswerable' WHEN count(*) FILTER (WHERE df IS NULL)::DOUBLE / count(*) >= 0.25 THEN 'uncertain' ELSE 'answerable' END AS verdict
FROM q LEFT JOIN df USING (token) GROUP BY item_id""")
def answer_gap(spark, sf_dir):
    """Which terms of a question no document has."""
    df = tokens(spark, sf_dir).groupBy("token").agg(F.count_distinct("doc_id").alias("df"))
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    own = asked.join(df, "token", "left").groupBy("item_id").agg(F.count("*").alias("terms"), F.count_if(F.col("df").isNull()).alias("missing"))
    share = F.col("missing") / F.col("terms")
    return own.withColumn("verdict", F.when(share >= 0.5, "unanswerable").when(share >= 0.25, "uncertain").otherwise("answerable"))


@query("lexical_rerank", [347], f"""WITH {TOKENS_SQL}, o AS (SELECT source, doc_id, count(DISTINCT token) FILTER (WHERE token IN ('the', 'and', 'of', 'in', 'to')) AS overlap FROM tokens GROUP BY ALL)
SELECT source, doc_id, overlap::BIGINT AS overlap FROM o QUALIFY overlap >= 5 OR row_number() OVER (PARTITION BY source ORDER BY overlap DESC, doc_id) <= 3""")
def lexical_rerank(spark, sf_dir):
    """Rows that pass the gate, and at least the three best of each group."""
    hit = F.when(F.col("token").isin("the", "and", "of", "in", "to"), F.col("token"))
    own = tokens(spark, sf_dir).groupBy("source", "doc_id").agg(F.count_distinct(hit).alias("overlap"))
    w = Window.partitionBy("source").orderBy(F.desc("overlap"), "doc_id")
    return own.withColumn("rn", F.row_number().over(w)).filter("overlap >= 5 or rn <= 3").drop("rn")


@query("session_novelty", [303], r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations),
f AS (SELECT conv_id, token, min(turn) AS first FROM t GROUP BY ALL), u AS (SELECT DISTINCT conv_id, turn, token FROM t)
SELECT conv_id, turn, count(*)::BIGINT AS terms, round(count(*) FILTER (WHERE first = turn)::DOUBLE / count(*), 6) AS novelty FROM u JOIN f USING (conv_id, token) GROUP BY conv_id, turn""")
def session_novelty(spark, sf_dir):
    """The share of a turn's terms that its conversation didn't have before."""
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    first = F.min("turn").over(Window.partitionBy("conv_id", "token"))
    marked = own.withColumn("new", (first == F.col("turn")).cast("int"))
    return marked.groupBy("conv_id", "turn").agg(F.count("*").alias("terms"), F.round(F.avg("new"), 6).alias("novelty"))
