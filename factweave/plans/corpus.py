"""Statistics and quality of the document collection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical
from ..sources.tables import read
from ..sources.views import CLAIMS_SQL, TOKENS_SQL, claims, tokens
from .registry import query


@query("inverse_document_frequency", [87], f"""WITH {TOKENS_SQL}
SELECT token, count(DISTINCT doc_id)::BIGINT AS df, round(ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)::DOUBLE), 6) AS idf
FROM tokens GROUP BY token""")
def inverse_document_frequency(spark, sf_dir):
    df = lexical.document_frequency(lexical.term_counts(tokens(spark, sf_dir)))
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query("tfidf_salience", [88], f"""WITH {TOKENS_SQL}, c AS (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY ALL),
d AS (SELECT token, ln((SELECT count(*) FROM documents) / count(*)::DOUBLE) AS idf FROM c GROUP BY token)
SELECT doc_id, token, round(tf * idf, 6) AS tfidf FROM c JOIN d USING (token)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * idf, 6) DESC, token) <= 5""")
def tfidf_salience(spark, sf_dir):
    """The five most salient tokens of each document: tokens are counted in their document's row, and travel once to their weight and once back."""
    docs = read(spark, sf_dir, "documents")
    counts = lexical.counts_of_lists(docs.select("doc_id", T.tokens(F.col("text")).alias("w")), "doc_id", "w").drop("length")
    n = docs.agg(F.count("*").alias("n"))
    idf = lexical.document_frequency(counts).crossJoin(F.broadcast(n)).select("token", F.log(F.col("n") / F.col("df")).alias("idf"))
    scored = counts.join(idf, "token").select("doc_id", "token", F.round(F.col("tf") * F.col("idf"), 6).alias("tfidf"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "token")
    return scored.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("doc_id", "token", "tfidf")


@query("sentence_units", [169, 170, 202], f"""WITH {CLAIMS_SQL}
SELECT doc_id, pos::BIGINT AS pos, claim_text FROM claims""")
def sentence_units(spark, sf_dir):
    return claims(spark, sf_dir).select("doc_id", "pos", "claim_text")


@query("exact_claim_dedup", [136], f"""WITH {CLAIMS_SQL}
SELECT doc_id, min(pos)::BIGINT AS pos, count(*)::BIGINT AS copies FROM claims GROUP BY doc_id, lower(trim(claim_text))""")
def exact_claim_dedup(spark, sf_dir):
    """Of a document's equal sentences the first stays."""
    own = claims(spark, sf_dir).groupBy("doc_id", F.lower(F.trim("claim_text")).alias("key"))
    return own.agg(F.min("pos").alias("pos"), F.count("*").alias("copies")).drop("key")


@query("content_fingerprints", [78, 138, 175], f"""WITH {CLAIMS_SQL}
SELECT doc_id, pos::BIGINT AS pos, 'sec_' || substr(sha256(doc_id || chr(31) || lang || chr(31) || lower(trim(claim_text))), 1, 24) AS section_id,
       sha256(lower(trim(claim_text))) AS fingerprint FROM claims""")
def content_fingerprints(spark, sf_dir):
    key = F.lower(F.trim("claim_text"))
    section = F.concat(F.lit("sec_"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "lang", key), 256), 1, 24))
    return claims(spark, sf_dir).select("doc_id", "pos", section.alias("section_id"), F.sha2(key, 256).alias("fingerprint"))


@query("template_lines", [145], """WITH l AS (
  SELECT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT source, line, count(DISTINCT doc_id)::BIGINT AS docs FROM l WHERE length(line) >= 20
GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3""")
def template_lines(spark, sf_dir):
    """Lines that several documents of a source share."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("line", F.trim("line")).filter(F.length("line") >= 20)
    return lines.groupBy("source", "line").agg(F.countDistinct("doc_id").alias("docs")).filter("docs >= 3")


@query("claim_quality_filter", [184, 187], rf"""WITH {CLAIMS_SQL}, m AS (SELECT *, length(claim_text) AS n,
  len(regexp_extract_all(claim_text, '[A-Z]')) AS caps, len(regexp_extract_all(claim_text, '[ ]')) + 1 AS words,
  len(regexp_extract_all(claim_text, '[^,;:()]{{11,}}')) AS clauses, regexp_matches(claim_text, '[0-9]|must|shall|should|doit|muss') AS signal FROM claims)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN n < 30 AND NOT signal THEN 'too short' WHEN regexp_matches(lower(claim_text), 'copyright|all rights reserved|license') THEN 'boilerplate'
  WHEN n BETWEEN 30 AND 80 AND NOT signal AND caps >= 0.6 * words THEN 'heading' WHEN n > 160 AND clauses >= 3 THEN 'split' ELSE 'keep' END AS verdict FROM m""")
def claim_quality_filter(spark, sf_dir):
    text = F.col("claim_text")
    n, signal = F.length(text), text.rlike("[0-9]|must|shall|should|doit|muss")
    titled = T.count_matches(text, "[A-Z]") >= 0.6 * (T.count_matches(text, "[ ]") + 1)
    verdict = (
        F.when((n < 30) & ~signal, "too short")
        .when(F.lower(text).rlike("copyright|all rights reserved|license"), "boilerplate")
        .when(n.between(30, 80) & ~signal & titled, "heading")
        .when((n > 160) & (T.count_matches(text, "[^,;:()]{11,}") >= 3), "split")
        .otherwise("keep")
    )
    return claims(spark, sf_dir).select("doc_id", "pos", verdict.alias("verdict"))


@query("relation_likelihood", [182], """WITH m AS (SELECT doc_id, greatest(len(regexp_extract_all(text, '[^ \n]+')), 1) AS words,
  len(regexp_extract_all(lower(text), '\\b(is|are|was|be|have|has|est|sont|ist|sind)\\b')) AS verbs, len(regexp_extract_all(text, '[.;:]')) AS punct,
  len(regexp_extract_all(text, '[.!?]')) AS sents, len(regexp_extract_all(text, '[|*#]')) AS marks FROM documents),
s AS (SELECT doc_id, least(greatest(0.35 * least(verbs * 20.0 / words, 1) + 0.25 * least(punct * 10.0 / words, 1) + 0.2 * least(sents * 10.0 / words, 1) - 0.6 * least(marks * 1.0 / words, 1), 0), 1) AS score FROM m)
SELECT doc_id, round(score::DOUBLE, 6) AS score, CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.35 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'none' END AS tier FROM s""")
def relation_likelihood(spark, sf_dir):
    """How likely a text states relations, from its verbs, signs, sentences and marks."""
    text = F.col("text")
    words = F.greatest(T.count_matches(text, "[^ \n]+"), F.lit(1))
    part = lambda n, factor: F.least(n * factor / words, F.lit(1.0))
    verbs = T.count_matches(F.lower(text), r"(?<![A-Za-z0-9_])(is|are|was|be|have|has|est|sont|ist|sind)(?![A-Za-z0-9_])")
    score = 0.35 * part(verbs, 20.0) + 0.25 * part(T.count_matches(text, "[.;:]"), 10.0) + 0.2 * part(T.count_matches(text, "[.!?]"), 10.0)
    score = T.clamp(score - 0.6 * part(T.count_matches(text, "[|*#]"), 1.0))
    tier = F.when(F.col("score") >= 0.55, "high").when(F.col("score") >= 0.35, "medium").when(F.col("score") >= 0.2, "low").otherwise("none")
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("score")).select("doc_id", F.round("score", 6).alias("score"), tier.alias("tier"))


@query("parse_confidence", [180], """SELECT doc_id, round((0.2 * least(length(text) / 1000.0, 1) + 0.25 * CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END
  + 0.2 * (1 - least(len(regexp_extract_all(text, '[|#$%&*]')) * 10.0 / greatest(length(text), 1), 1)) + 0.35 * least(len(regexp_extract_all(text, '[.!?]')) / 5.0, 1))::DOUBLE, 5) AS confidence FROM documents""")
def parse_confidence(spark, sf_dir):
    text = F.col("text")
    noise = F.least(T.count_matches(text, "[|#$%&*]") * 10.0 / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))
    parts = 0.2 * F.least(F.length(text) / 1000.0, F.lit(1.0)) + 0.25 * F.when(F.contains(text, F.lit("\n")), 1).otherwise(0)
    parts = parts + 0.2 * (1 - noise) + 0.35 * F.least(T.count_matches(text, "[.!?]") / 5.0, F.lit(1.0))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(parts, 5).alias("confidence"))


@query("fixed_chunks", [174], """SELECT lang, count(*)::BIGINT AS chunks, sum(n)::BIGINT AS chars, max(n)::BIGINT AS longest FROM (
  SELECT lang, length(substr(text, 1 + i * 1300, 1500)) AS n FROM (SELECT lang, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 1300.0))::BIGINT)) AS i FROM documents)) GROUP BY lang""")
def fixed_chunks(spark, sf_dir):
    """Chunks of 1500 characters that overlap by 200."""
    docs = read(spark, sf_dir, "documents")
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - 200) / 1300.0)) - 1
    chunks = docs.select("lang", "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("i"))
    size = F.length(F.substr("text", 1 + F.col("i") * 1300, F.lit(1500)))
    return chunks.select("lang", size.cast("long").alias("n")).groupBy("lang").agg(F.count("*").alias("chunks"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


@query("corpus_audit", [85, 335, 338], f"""WITH {CLAIMS_SQL}, a AS (SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS n,
  count(*) FILTER (WHERE regexp_matches(claim_text, '[0-9]')) AS figures, count(DISTINCT lower(claim_text)) AS different FROM claims GROUP BY lang)
SELECT lang, docs::BIGINT AS docs, n::BIGINT AS claims, round(figures::DOUBLE / n, 6) AS figure_share, round(1 - different::DOUBLE / n, 6) AS repeat_share FROM a""")
def corpus_audit(spark, sf_dir):
    own = claims(spark, sf_dir).groupBy("lang").agg(
        F.countDistinct("doc_id").alias("docs"),
        F.count("*").alias("claims"),
        F.count_if(F.col("claim_text").rlike("[0-9]")).alias("figures"),
        F.countDistinct(F.lower("claim_text")).alias("different"),
    )
    share = lambda a, b: F.round(a / b, 6)
    return own.select("lang", "docs", "claims", share(F.col("figures"), F.col("claims")).alias("figure_share"), F.round(1 - F.col("different") / F.col("claims"), 6).alias("repeat_share"))


@query("token_co_occurrence", [266], f"""WITH {TOKENS_SQL}, t AS (SELECT DISTINCT source, token FROM tokens WHERE length(token) >= 8),
k AS (SELECT token FROM t GROUP BY token HAVING count(*) BETWEEN 2 AND 4), o AS (SELECT source, token FROM t JOIN k USING (token))
SELECT a.token AS a, b.token AS b, count(*)::BIGINT AS groups FROM o a JOIN o b ON a.source = b.source AND a.token < b.token GROUP BY ALL HAVING count(*) >= 3""")
def token_co_occurrence(spark, sf_dir):
    """Rare long tokens that occur in the same sources: two that share three of the two to four that each may have. Words in any number
    of documents take part in window_co_occurrence."""
    own = tokens(spark, sf_dir).filter(F.length("token") >= 8).select("source", "token")
    return lexical.co_occurrence_of_rare(own, "source", "token", 3, 4)


@query("dominant_language_terms", [87], f"""WITH {TOKENS_SQL}, c AS (SELECT lang, token, count(*) AS n FROM tokens GROUP BY ALL)
SELECT lang, token, n::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) <= 20""")
def dominant_language_terms(spark, sf_dir):
    counts = tokens(spark, sf_dir).groupBy("lang", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "token")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn <= 20").drop("rn")


@query("document_heatmap", [333], """WITH t AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, coalesce(max(n) FILTER (WHERE lang = 'de'), 0)::BIGINT AS de, coalesce(max(n) FILTER (WHERE lang = 'en'), 0)::BIGINT AS en,
       coalesce(max(n) FILTER (WHERE lang = 'es'), 0)::BIGINT AS es, coalesce(max(n) FILTER (WHERE lang = 'fr'), 0)::BIGINT AS fr FROM t GROUP BY source""")
def document_heatmap(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)
