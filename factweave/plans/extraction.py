"""Values, entities and markers in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read
from ..sources.views import CLAIMS_SQL, claims
from .registry import query


@query("pii_redaction", [196], r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[IP]', 'g'),
  '\+?[0-9][0-9 ()-]{7,}[0-9]', '[PHONE]', 'g') AS redacted FROM documents""")
def pii_redaction(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query("number_parse", [203, 206], rf"""WITH {CLAIMS_SQL}, x AS (SELECT doc_id, pos, claim_text,
  regexp_extract(claim_text, '([0-9]+(?:[.,][0-9]+)?)', 1) AS num FROM claims WHERE regexp_matches(claim_text, '[0-9]'))
SELECT doc_id, pos::BIGINT AS pos, round(CAST(replace(num, ',', '.') AS DOUBLE), 6) AS value,
  CASE WHEN regexp_matches(claim_text, '(<=|>=|<|>|at least|at most) ?[0-9]') THEN 'inequality' WHEN regexp_matches(claim_text, '[0-9] ?(-|to) ?[0-9]') THEN 'interval'
       WHEN regexp_matches(claim_text, '[0-9] ?%') THEN 'percent' ELSE 'scalar' END AS kind FROM x WHERE length(num) <= 12""")
def number_parse(spark, sf_dir):
    text = F.col("claim_text")
    num = F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1)
    kind = (
        F.when(text.rlike("(<=|>=|<|>|at least|at most) ?[0-9]"), "inequality")
        .when(text.rlike("[0-9] ?(-|to) ?[0-9]"), "interval")
        .when(text.rlike("[0-9] ?%"), "percent")
        .otherwise("scalar")
    )
    own = claims(spark, sf_dir).filter(text.rlike("[0-9]")).withColumn("num", num).filter(F.length("num") <= 12)
    return own.select("doc_id", "pos", F.round(F.replace("num", F.lit(","), F.lit(".")).cast("double"), 6).alias("value"), kind.alias("kind"))


@query("value_frames", [204, 205], r"""SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '#[0-9]+') THEN 'VERSION' ELSE 'TEXT' END AS kind,
  coalesce(TRY_CAST(regexp_extract(p_brand, '#([0-9])', 1) AS BIGINT), -1) AS major, coalesce(TRY_CAST(regexp_extract(p_brand, '#[0-9]([0-9])', 1) AS BIGINT), -1) AS minor FROM part""")
def value_frames(spark, sf_dir):
    part = lambda pattern: F.coalesce(F.regexp_extract("p_brand", pattern, 1).try_cast("long"), F.lit(-1))
    kind = F.when(F.col("p_brand").rlike("#[0-9]+"), "VERSION").otherwise("TEXT")
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), part("#([0-9])").alias("major"), part("#[0-9]([0-9])").alias("minor"))


@query("modality_and_negation", [209, 223], rf"""WITH {CLAIMS_SQL}, l AS (SELECT doc_id, pos, lower(claim_text) AS t FROM claims)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN regexp_matches(t, '\b(must not|shall not|may not)\b') THEN 'prohibited' WHEN regexp_matches(t, '\b(must|shall|required|doit|muss)\b') THEN 'required'
  WHEN regexp_matches(t, '\b(should|recommended|devrait|soll)\b') THEN 'recommended' WHEN regexp_matches(t, '\b(may|can|peut|kann)\b') THEN 'allowed' ELSE 'stated' END AS modality,
  len(regexp_extract_all(t, '\b(not|no|never|ne|pas|nicht|kein)\b')) % 2 = 1 AS negated FROM l""")
def modality_and_negation(spark, sf_dir):
    low = F.lower("claim_text")
    modality = (
        F.when(low.rlike(r"(?<![A-Za-z0-9_])(must not|shall not|may not)(?![A-Za-z0-9_])"), "prohibited")
        .when(low.rlike(r"(?<![A-Za-z0-9_])(must|shall|required|doit|muss)(?![A-Za-z0-9_])"), "required")
        .when(low.rlike(r"(?<![A-Za-z0-9_])(should|recommended|devrait|soll)(?![A-Za-z0-9_])"), "recommended")
        .when(low.rlike(r"(?<![A-Za-z0-9_])(may|can|peut|kann)(?![A-Za-z0-9_])"), "allowed")
        .otherwise("stated")
    )
    negated = T.count_matches(low, r"(?<![A-Za-z0-9_])(not|no|never|ne|pas|nicht|kein)(?![A-Za-z0-9_])") % 2 == 1
    return claims(spark, sf_dir).select("doc_id", "pos", modality.alias("modality"), negated.alias("negated"))


@query("identifier_tokens", [41, 189, 199], r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_/-]{2,}')) AS token FROM documents)
SELECT doc_id, count(*)::BIGINT AS identifiers, count(DISTINCT token)::BIGINT AS different,
  sum(CASE WHEN regexp_matches(token, '[_/]') THEN 5 WHEN regexp_matches(token, '[0-9]') THEN 4 ELSE 3 END)::BIGINT AS weight
FROM t WHERE regexp_matches(token, '[0-9_/]') OR regexp_matches(token, '^[A-Z]{2,}$') GROUP BY doc_id""")
def identifier_tokens(spark, sf_dir):
    """Tokens that look like identifiers, weighed by their shape."""
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_/-]{2,}"), F.lit(0))).alias("token"))
    token = F.col("token")
    weight = F.when(token.rlike("[_/]"), 5).when(token.rlike("[0-9]"), 4).otherwise(3)
    own = found.filter(token.rlike("[0-9_/]") | token.rlike("^[A-Z]{2,}$")).groupBy("doc_id")
    return own.agg(F.count("*").alias("identifiers"), F.countDistinct("token").alias("different"), F.sum(weight).alias("weight"))


@query("entity_surfaces", [220], r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,5}\b')) AS surface FROM documents)
SELECT surface, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS mentions, CASE WHEN regexp_matches(surface, '^[A-Z]{2,5}$') THEN 'acronym' ELSE 'name' END AS kind
FROM t WHERE length(surface) <= 80 GROUP BY surface HAVING count(DISTINCT doc_id) >= 2""")
def entity_surfaces(spark, sf_dir):
    pattern = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,5}(?![A-Za-z0-9_])"
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("surface"))
    own = found.filter(F.length("surface") <= 80).groupBy("surface").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("mentions")).filter("docs >= 2")
    return own.withColumn("kind", F.when(F.col("surface").rlike("^[A-Z]{2,5}$"), "acronym").otherwise("name"))


@query("comparability_gate", [42], rf"""WITH {CLAIMS_SQL}, m AS (SELECT doc_id, pos, len(regexp_extract_all(claim_text, '[0-9]+')) AS strong,
  len(regexp_extract_all(lower(claim_text), '\b(than|more|less|plus|moins|mehr|weniger)\b')) AS weak FROM claims)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN strong >= 1 THEN 'accept' WHEN weak >= 2 THEN 'accept' WHEN weak = 1 THEN 'uncertain' ELSE 'reject' END AS verdict FROM m""")
def comparability_gate(spark, sf_dir):
    strong = T.count_matches(F.col("claim_text"), "[0-9]+")
    weak = T.count_matches(F.lower("claim_text"), r"(?<![A-Za-z0-9_])(than|more|less|plus|moins|mehr|weniger)(?![A-Za-z0-9_])")
    verdict = F.when(strong >= 1, "accept").when(weak >= 2, "accept").when(weak == 1, "uncertain").otherwise("reject")
    return claims(spark, sf_dir).select("doc_id", "pos", verdict.alias("verdict"))


@query("answer_segmentation", [201], r"""WITH s AS (SELECT conv_id, turn, role, trim(unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]?'))) AS part FROM conversations)
SELECT conv_id, turn, count(*)::BIGINT AS parts, count(*) FILTER (WHERE regexp_matches(part, '[0-9]'))::BIGINT AS figures, max(length(part))::BIGINT AS longest
FROM s WHERE length(part) >= 10 GROUP BY conv_id, turn""")
def answer_segmentation(spark, sf_dir):
    parts = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))).alias("part"))
    own = parts.withColumn("part", F.trim("part")).filter(F.length("part") >= 10).groupBy("conv_id", "turn")
    return own.agg(F.count("*").alias("parts"), F.count_if(F.col("part").rlike("[0-9]")).alias("figures"), F.max(F.length("part")).cast("long").alias("longest"))


@query("page_hosts_and_titles", [23], r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang,
  regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages""")
def page_hosts_and_titles(spark, sf_dir):
    pick = lambda column, pattern: F.regexp_extract(column, pattern, 1)
    return read(spark, sf_dir, "pages").select("page_id", pick("html", "<title>([^<]*)</title>").alias("title"), pick("html", 'lang="([a-z]+)"').alias("lang"), pick("url", "://([^/?#]+)").alias("host"))


@query("column_letters", [8], """SELECT p_partkey, (26 * (p_size % 26 + 1) + p_partkey % 26)::BIGINT AS column_index FROM part""")
def column_letters(spark, sf_dir):
    """Spreadsheet column names to zero-based numbers: 'AB' is 27."""
    letter = lambda n: F.char(F.lit(65) + n)
    named = read(spark, sf_dir, "part").select("p_partkey", F.concat(letter(F.col("p_size") % 26), letter(F.col("p_partkey") % 26)).alias("name"))
    index = F.aggregate(F.filter(F.split("name", ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64) - 1
    return named.select("p_partkey", index.alias("column_index"))
