"""Language, personal data, enumerations, keys, cues and references in text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.statements import STATEMENTS_SQL, statements
from ..sources.tables import read
from ..sources.views import CLAIMS_SQL, claims
from .lineage import AXES_SQL, axes
from .registry import query

# Frequent words of four languages.
COMMON = {
    "de": "der die das und ist nicht mit den von für ein eine zu im auf".split(),
    "en": "the and of to in is that it for with as was on are this".split(),
    "es": "el la los las de y que en un una por con no para se".split(),
    "fr": "le la les des et est une un dans que pour qui sur pas au".split(),
}


def in_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def count_of(words):
    """How many of the words in column w are among the given ones."""
    return F.size(F.filter("w", lambda x: x.isin(words)))


DETECT_SQL = rf"""tw AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM conversations),
hits AS (SELECT conv_id, turn, {', '.join(f"count(*) FILTER (WHERE w IN ({in_list(ws)})) AS {lang}" for lang, ws in COMMON.items())} FROM tw GROUP BY ALL),
said AS (SELECT c.conv_id, c.turn, coalesce(de, 0) AS de, coalesce(en, 0) AS en, coalesce(es, 0) AS es, coalesce(fr, 0) AS fr FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN hits h ON c.conv_id = h.conv_id AND c.turn = h.turn),
best AS (SELECT *, greatest(de, en, es, fr) AS top, de + en + es + fr AS total, CASE greatest(de, en, es, fr) WHEN 0 THEN 'und' WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END AS lang FROM said),
own AS (SELECT *, CASE WHEN top > 0 AND top >= 0.5 * total THEN lang END AS sure FROM best)"""


@query("language_detection", [195], f"""WITH {DETECT_SQL} SELECT conv_id, turn, coalesce(sure, last_value(sure IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'und') AS lang,
  round(CASE WHEN total > 0 THEN top::DOUBLE / total ELSE 0 END, 6) AS confidence, sure IS NULL AS from_context, len(list_filter([de, en, es, fr], lambda x: x > 0 AND x >= 0.3 * total)) > 1 AS multilingual FROM own""")
def language_detection(spark, sf_dir):
    """The language of each turn by its frequent words; where they don't agree, that of the conversation so far. Nothing is learnt."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    words = turns.select("conv_id", "turn", F.flatten(F.transform("texts", T.words)).alias("w"))
    counted = words.select("conv_id", "turn", *[count_of(ws).alias(lang) for lang, ws in COMMON.items()])
    top, total = F.greatest(*COMMON), sum((F.col(c) for c in COMMON), F.lit(0))
    lang = F.when(F.col("top") == 0, "und")
    for name in COMMON:
        lang = lang.when(F.col("top") == F.col(name), name)
    own = counted.withColumn("top", top).withColumn("total", total).withColumn("sure", F.when((F.col("top") > 0) & (F.col("top") >= 0.5 * F.col("total")), lang))
    before = F.last("sure", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    several = F.size(F.filter(F.array(*COMMON), lambda x: (x > 0) & (x >= 0.3 * F.col("total")))) > 1
    share = F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(0.0)
    return own.select("conv_id", "turn", F.coalesce("sure", before, F.lit("und")).alias("lang"), F.round(share, 6).alias("confidence"), F.col("sure").isNull().alias("from_context"), several.alias("multilingual"))


CARD = "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}"


def luhn_valid(number):
    """The check digit of a card number: from the right, every second digit counts double, its digits summed."""
    digits = F.transform(F.filter(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x).when(x >= 5, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


@query("personal_data", [196], rf"""WITH e AS (SELECT doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g') AS t1, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS emails FROM documents),
c AS (SELECT doc_id, emails, t1, list_distinct(regexp_extract_all(t1, '{CARD}')) AS found FROM e),
v AS (SELECT doc_id, emails, t1, list_sort(list_filter(found, lambda x: list_sum(list_transform(range(1, length(regexp_replace(x, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN (length(regexp_replace(x, '[^0-9]', '', 'g')) - i) % 2 = 0 THEN substr(regexp_replace(x, '[^0-9]', '', 'g'), i, 1)::INT
  ELSE CASE WHEN substr(regexp_replace(x, '[^0-9]', '', 'g'), i, 1)::INT >= 5 THEN 2 * substr(regexp_replace(x, '[^0-9]', '', 'g'), i, 1)::INT - 9 ELSE 2 * substr(regexp_replace(x, '[^0-9]', '', 'g'), i, 1)::INT END END)) % 10 = 0)) AS cards FROM c),
r AS (SELECT doc_id, emails, len(cards) AS cards, list_reduce(list_concat([t1], cards), lambda acc, x: replace(acc, x, '[CARD]')) AS t2 FROM v),
i AS (SELECT doc_id, emails, cards, regexp_replace(t2, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}', '[IP]', 'g') AS t3, len(regexp_extract_all(t2, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}')) AS ips FROM r)
SELECT doc_id, emails::BIGINT AS emails, cards::BIGINT AS cards, ips::BIGINT AS ips, len(regexp_extract_all(t3, '\+?[0-9][0-9 ()-]{{6,}}[0-9]'))::BIGINT AS phones, sha256(regexp_replace(t3, '\+?[0-9][0-9 ()-]{{6,}}[0-9]', '[PHONE]', 'g')) AS redacted_sha256 FROM i""")
def personal_data(spark, sf_dir):
    """Personal data masked in order of priority, so that no two overlap: addresses, card numbers whose check digit is right, IPs, phone numbers of 8 digits at least."""
    email, ip, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"\+?[0-9][0-9 ()-]{6,}[0-9]"
    docs = read(spark, sf_dir, "documents").select("doc_id", T.count_matches(F.col("text"), email).alias("emails"), F.regexp_replace("text", email, "[EMAIL]").alias("t1"))
    found = F.array_sort(F.filter(F.array_distinct(F.regexp_extract_all("t1", F.lit(CARD), F.lit(0))), luhn_valid))
    docs = docs.withColumn("found", found).select("doc_id", "emails", F.size("found").cast("long").alias("cards"), F.aggregate("found", F.col("t1"), lambda t, x: F.replace(t, x, F.lit("[CARD]"))).alias("t2"))
    docs = docs.select("doc_id", "emails", "cards", T.count_matches(F.col("t2"), ip).alias("ips"), F.regexp_replace("t2", ip, "[IP]").alias("t3"))
    return docs.select("doc_id", "emails", "cards", "ips", T.count_matches(F.col("t3"), phone).alias("phones"), F.sha2(F.regexp_replace("t3", phone, "[PHONE]"), 256).alias("redacted_sha256"))


@query("log_lines", [197], r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00-\x1F]+', ' ', 'g'), '(token|password|secret|key) = "[^"]*"', '\1 = "***"', 'g') AS t, len(regexp_extract_all(text, '(?:token|password|secret|key) = "[^"]*"')) AS masked FROM documents)
SELECT doc_id, masked::BIGINT AS masked, length(t) > 500 AS truncated, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS line FROM c""")
def log_lines(spark, sf_dir):
    """A text made safe for a log: no control characters, secrets masked, 500 characters."""
    secret = r'(token|password|secret|key) = "[^"]*"'
    clean = F.regexp_replace(F.regexp_replace("text", r"[\x00-\x1F]+", " "), secret, '$1 = "***"')
    own = read(spark, sf_dir, "documents").select("doc_id", T.count_matches(F.col("text"), secret).alias("masked"), clean.alias("t"))
    long = F.length("t") > 500
    return own.select("doc_id", "masked", long.alias("truncated"), F.when(long, F.concat(F.substring("t", 1, 500), F.lit("..."))).otherwise(F.col("t")).alias("line"))


@query("enumerations", [200], f"""WITH {CLAIMS_SQL}, p AS (SELECT doc_id, pos, lower(claim_text) AS t FROM claims), e AS (SELECT doc_id, pos, t, list_filter(list_transform(string_split(regexp_replace(t, ' (and|et|und|y) ', ', ', 'g'), ','), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 40) AS parts
  FROM p WHERE len(string_split(t, ',')) >= 3 AND regexp_matches(t, ' (and|et|und|y) ') AND NOT regexp_matches(' ' || t || ' ', ' (or|ou|oder|either|soit) '))
SELECT doc_id, pos::BIGINT AS pos, len(parts)::BIGINT AS items, sha256(array_to_string(list_sort(list_distinct(parts)), '|')) AS merged FROM e WHERE len(parts) >= 3""")
def enumerations(spark, sf_dir):
    """Sentences that list things: two commas and a conjunction, no alternative; the items as a set have one key, by which sibling claims merge."""
    low = claims(spark, sf_dir).select("doc_id", "pos", F.lower("claim_text").alias("t"))
    lists = low.filter((F.size(F.split("t", ",")) >= 3) & F.col("t").rlike(" (and|et|und|y) ") & ~F.concat(F.lit(" "), "t", F.lit(" ")).rlike(" (or|ou|oder|either|soit) "))
    parts = F.filter(F.transform(F.split(F.regexp_replace("t", " (and|et|und|y) ", ", "), ","), lambda x: F.trim(x)), lambda x: F.length(x).between(2, 40))
    own = lists.withColumn("parts", parts).filter(F.size("parts") >= 3)
    return own.select("doc_id", "pos", F.size("parts").cast("long").alias("items"), F.sha2(F.array_join(F.array_sort(F.array_distinct("parts")), "|"), 256).alias("merged"))


@query("claim_keys", [207], f"""WITH {STATEMENTS_SQL}, k AS (SELECT subject, object_text, CASE WHEN regexp_matches(object_text, '^version') THEN 'min_version' WHEN regexp_matches(object_text, '^is (enabled|disabled)') THEN 'feature_enabled' WHEN regexp_matches(object_text, '^at most .* %$') THEN 'share_limit' WHEN regexp_matches(object_text, '^at most') THEN 'upper_limit_' || regexp_extract(object_text, '([a-z]+)$', 1)
  WHEN regexp_matches(object_text, '^at least') THEN 'lower_limit' WHEN regexp_matches(object_text, '^between') THEN 'range' WHEN regexp_matches(object_text, '^[0-9]+ ') THEN 'value_' || regexp_extract(object_text, '([^ ]+)$', 1) END AS claim_key FROM statements)
SELECT coalesce(claim_key, 'none') AS claim_key, count(*)::BIGINT AS claims, count(DISTINCT subject)::BIGINT AS subjects, count(DISTINCT object_text)::BIGINT AS answers FROM k GROUP BY 1""")
def claim_keys(spark, sf_dir):
    """The question that a statement answers, from patterns in order, with the answers that are given to it."""
    text = F.col("object_text")
    key = (
        F.when(text.rlike("^version"), "min_version")
        .when(text.rlike("^is (enabled|disabled)"), "feature_enabled")
        .when(text.rlike("^at most .* %$"), "share_limit")
        .when(text.rlike("^at most"), F.concat(F.lit("upper_limit_"), F.regexp_extract(text, "([a-z]+)$", 1)))
        .when(text.rlike("^at least"), "lower_limit")
        .when(text.rlike("^between"), "range")
        .when(text.rlike("^[0-9]+ "), F.concat(F.lit("value_"), F.regexp_extract(text, "([^ ]+)$", 1)))
        .otherwise("none")
    )
    return statements(spark, sf_dir).groupBy(key.alias("claim_key")).agg(F.count("*").alias("claims"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object_text").alias("answers"))


@query("spec_facts", [208], r"""WITH l AS (SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, trim(unnest(m)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS m FROM documents)),
t AS (SELECT doc_id, pos, line, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM l WHERE contains(line, '|')),
k AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '[A-Za-z][A-Za-z0-9_]* = "[^"]*"')) AS pair FROM l)
SELECT doc_id, pos::BIGINT AS pos, 'row' AS kind, cells[1] AS key, len(cells)::VARCHAR AS value FROM t WHERE len(cells) >= 2 UNION ALL
SELECT doc_id, pos, 'pair', regexp_extract(pair, '^([A-Za-z0-9_]+) = ', 1), regexp_extract(pair, '"([^"]*)"', 1) FROM k""")
def spec_facts(spark, sf_dir):
    """Facts that stand in table rows (first cell and number of cells) and in key = "value" pairs."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("line").alias("line"))
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda c: c != "")
    rows = lines.filter(F.contains("line", F.lit("|"))).withColumn("cells", cells).filter(F.size("cells") >= 2)
    pairs = lines.select("doc_id", "pos", F.explode(F.regexp_extract_all("line", F.lit('[A-Za-z][A-Za-z0-9_]* = "[^"]*"'), F.lit(0))).alias("pair"))
    return rows.select("doc_id", "pos", F.lit("row").alias("kind"), F.col("cells")[0].alias("key"), F.size("cells").cast("string").alias("value")).unionByName(
        pairs.select("doc_id", "pos", F.lit("pair").alias("kind"), F.regexp_extract("pair", "^([A-Za-z0-9_]+) = ", 1).alias("key"), F.regexp_extract("pair", '"([^"]*)"', 1).alias("value"))
    )


@query("relation_patterns", [210], r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), x AS (SELECT doc_id, lang, w[i] AS a, w[i + 1] AS m, w[i + 2] AS b FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, lang, a, b, CASE WHEN m IN ('is', 'are', 'est', 'ist', 'es') THEN 'IS_A' WHEN m IN ('of', 'de', 'von', 'du') THEN 'PART_OF' WHEN m IN ('with', 'avec', 'mit', 'con') THEN 'USES' WHEN m IN ('for', 'pour', 'für', 'para') THEN 'SERVES' END AS relation FROM x WHERE length(a) >= 4 AND length(b) >= 4)
SELECT lang, relation, a, b, count(*)::BIGINT AS mentions, count(DISTINCT doc_id)::BIGINT AS docs FROM r WHERE relation IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2""")
def relation_patterns(spark, sf_dir):
    """Typed relations between words by what stands between them, in four languages; seen in two documents at least."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", T.words(F.col("text")).alias("w")).filter(F.size("w") >= 3)
    triples = docs.select("doc_id", "lang", F.explode(F.zip_with(F.zip_with(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2), lambda a, m: F.struct(a.alias("a"), m.alias("m"))), F.slice("w", 3, F.size("w") - 2), lambda x, b: F.struct(x["a"].alias("a"), x["m"].alias("m"), b.alias("b")))).alias("t"))
    m = F.col("t.m")
    relation = F.when(m.isin("is", "are", "est", "ist", "es"), "IS_A").when(m.isin("of", "de", "von", "du"), "PART_OF").when(m.isin("with", "avec", "mit", "con"), "USES").when(m.isin("for", "pour", "für", "para"), "SERVES")
    own = triples.select("doc_id", "lang", "t.a", "t.b", relation.alias("relation")).filter("relation is not null and length(a) >= 4 and length(b) >= 4")
    return own.groupBy("lang", "relation", "a", "b").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs")).filter("docs >= 2")


@query("applicability_candidates", [211], r"""WITH v AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)*'))) AS value FROM documents)
SELECT doc_id, value, len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)*')) - len(list_filter(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)*'), lambda x: x <> value)) AS mentions, strpos(text, value) <= greatest(1, length(text) // 10) AS in_header,
  regexp_matches(lower(substr(text, greatest(1, strpos(text, value) - 200)::BIGINT, (400 + length(value))::BIGINT)), 'license|version|copyright|reserved') AS near_marker FROM v""")
def applicability_candidates(spark, sf_dir):
    """Numbers that may say what a document applies to: how often, whether in its first tenth, whether a marker is within 200 characters."""
    pattern = F.lit(r"[0-9]+(?:\.[0-9]+)*")
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    own = read(spark, sf_dir, "documents").select("doc_id", "text", found.alias("all")).select("doc_id", "text", "all", F.explode(F.array_distinct("all")).alias("value"))
    at = F.instr("text", F.col("value"))
    around = F.substr("text", F.greatest(F.lit(1), at - 200), 400 + F.length("value"))
    mentions = F.size(F.filter("all", lambda x: x == F.col("value"))).cast("long")
    return own.select("doc_id", "value", mentions.alias("mentions"), (at <= F.greatest(F.lit(1), F.floor(F.length("text") / 10))).alias("in_header"), F.lower(around).rlike("license|version|copyright|reserved").alias("near_marker"))


IDS_SQL = """ids AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'dualuse_reg_' || year(o_orderdate) || '_' || (o_orderkey % 500) || '_' || lower(right(sha256(o_orderkey::VARCHAR), 8)) WHEN 1 THEN 'cs25_amdt_' || (o_orderkey % 30) WHEN 2 THEN 'AC_' || (20 + o_orderkey % 9) || '-' || (o_orderkey % 7) || CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE '' END || '_' || lower(right(sha256(o_orderkey::VARCHAR), 8)) ELSE 'ETSO-C' || (o_orderkey % 200) || 'c_amd' || (o_orderkey % 20) END AS doc_ref FROM orders)"""


def document_ids(spark, sf_dir):
    """Orders as documents whose ids hold years, amendments and regulatory keys."""
    n, text = F.col("o_orderkey"), lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    digest = F.right(F.sha2(n.cast("string"), 256), F.lit(8))
    made = (
        F.when(n % 4 == 0, text("dualuse_reg_", F.year("o_orderdate"), "_", n % 500, "_", digest))
        .when(n % 4 == 1, text("cs25_amdt_", n % 30))
        .when(n % 4 == 2, text("AC_", 20 + n % 9, "-", n % 7, F.when(n % 3 == 0, "A").otherwise(""), "_", digest))
        .otherwise(text("ETSO-C", n % 200, "c_amd", n % 20))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", made.alias("doc_ref"))


@query("document_id_hints", [212, 219], rf"""WITH {IDS_SQL} SELECT o_orderkey, coalesce(TRY_CAST(regexp_extract(doc_ref, '_(?:reg|del)_([0-9]{{4}})_', 1) AS BIGINT), -1) AS year, coalesce(TRY_CAST(regexp_extract(doc_ref, '(?:amdt_|_amd)([0-9]+)', 1) AS BIGINT), -1) AS amendment,
  CASE WHEN regexp_matches(doc_ref, 'ETSO-C[0-9]+[a-z]?') THEN upper(regexp_extract(doc_ref, '(ETSO-C[0-9]+[a-z]?)', 1)) WHEN regexp_matches(doc_ref, 'AC_[0-9.]+-[0-9]+[A-Z]?') THEN 'AC ' || regexp_extract(doc_ref, 'AC_([0-9.]+-[0-9]+[A-Z]?)', 1) ELSE 'none' END AS reg_key FROM ids""")
def document_id_hints(spark, sf_dir):
    """Year, amendment and regulatory key as a document's id gives them."""
    ref = F.col("doc_ref")
    whole = lambda p: F.coalesce(F.regexp_extract(ref, p, 1).try_cast("long"), F.lit(-1))
    etso, circular = "(ETSO-C[0-9]+[a-z]?)", "AC_([0-9.]+-[0-9]+[A-Z]?)"
    key = F.when(ref.rlike(etso), F.upper(F.regexp_extract(ref, etso, 1))).when(ref.rlike(circular), F.concat(F.lit("AC "), F.regexp_extract(ref, circular, 1))).otherwise("none")
    return document_ids(spark, sf_dir).select("o_orderkey", whole("_(?:reg|del)_([0-9]{4})_").alias("year"), whole("(?:amdt_|_amd)([0-9]+)").alias("amendment"), key.alias("reg_key"))


CUES = {"polarity": "not no never non pas jamais nicht kein nie nunca".split(), "override": "but however except mais sauf aber außer pero salvo".split(), "conditional": "if when unless si quand wenn falls cuando".split(), "scope": "only all each tous chaque alle jede todos cada".split(), "legal": "license licensed rights copyright droits recht derechos".split()}


@query("passage_heuristics", [216, 218], rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x IN ({in_list(ws)}))) AS {k}" for k, ws in CUES.items())} FROM w)
SELECT doc_id, {', '.join(f"round(least({k} * 20.0 / greatest(n, 1), 1)::DOUBLE, 6) AS {k}" for k in CUES)}, polarity % 2 = 1 AS negated, override > 0 AND conditional > 0 AS exception FROM c""")
def passage_heuristics(spark, sf_dir):
    """Scores of cue families in a passage: negation, override, condition, scope, legal."""
    words = read(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    own = words.select("doc_id", F.greatest(F.size("w"), F.lit(1)).alias("n"), *[count_of(ws).alias(k) for k, ws in CUES.items()])
    scores = [F.round(F.least(F.col(k) * 20.0 / F.col("n"), F.lit(1.0)), 6).alias(k) for k in CUES]
    return own.select("doc_id", *scores, (F.col("polarity") % 2 == 1).alias("negated"), ((F.col("override") > 0) & (F.col("conditional") > 0)).alias("exception"))


@query("context_inheritance", [217], f"""WITH {CLAIMS_SQL}, d AS (SELECT doc_id, CASE WHEN count(DISTINCT length(claim_text) % 3) = 1 THEN 'SPECIFIC' WHEN count(*) > 12 THEN 'MIXED' ELSE 'GENERAL' END AS scope FROM claims GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN regexp_matches(claim_text, '[0-9]') THEN 'strong' WHEN regexp_matches(claim_text, '[A-Z]{{2,}}') THEN 'weak' ELSE 'none' END AS marker, regexp_matches(lower(claim_text), ' (but|mais|aber|pero) ') AS override FROM claims)
SELECT scope, marker, CASE WHEN override THEN 'local' WHEN marker = 'strong' THEN 'local' WHEN scope = 'SPECIFIC' THEN 'document' WHEN marker = 'weak' AND scope = 'MIXED' THEN 'uncertain' WHEN scope = 'MIXED' THEN 'none' ELSE 'general' END AS inherited, count(*)::BIGINT AS claims FROM m JOIN d USING (doc_id) GROUP BY ALL""")
def context_inheritance(spark, sf_dir):
    """Which scope a claim has: its own markers and overrides come before the document's scope."""
    own = claims(spark, sf_dir)
    kinds = F.countDistinct(F.length("claim_text") % 3)
    docs = own.groupBy("doc_id").agg(F.when(kinds == 1, "SPECIFIC").when(F.count("*") > 12, "MIXED").otherwise("GENERAL").alias("scope"))
    marker = F.when(F.col("claim_text").rlike("[0-9]"), "strong").when(F.col("claim_text").rlike("[A-Z]{2,}"), "weak").otherwise("none")
    marked = own.select("doc_id", marker.alias("marker"), F.lower("claim_text").rlike(" (but|mais|aber|pero) ").alias("override")).join(docs, "doc_id")
    scope, local = F.col("scope"), F.col("override") | (F.col("marker") == "strong")
    inherited = F.when(local, "local").when(scope == "SPECIFIC", "document").when((F.col("marker") == "weak") & (scope == "MIXED"), "uncertain").when(scope == "MIXED", "none").otherwise("general")
    return marked.groupBy("scope", "marker", inherited.alias("inherited")).agg(F.count("*").alias("claims"))


@query("concept_types", [222], """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'pipe|ring|bolt|plate|frame|nut') THEN 'structural' WHEN regexp_matches(lower(p_type), 'standard|promo') THEN 'regulatory' WHEN regexp_matches(lower(p_name), 'ing$|tion$') THEN 'procedural' ELSE 'abstract' END AS concept_type,
  CASE WHEN regexp_matches(lower(p_name), 'pipe|ring|bolt|plate|frame|nut') THEN 0.9 WHEN regexp_matches(lower(p_type), 'standard|promo') THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM part""")
def concept_types(spark, sf_dir):
    """The kind of concept that a label names, by its words and its context; the first that fits."""
    name, context = F.lower("p_name"), F.lower("p_type")
    structural, regulatory = name.rlike("pipe|ring|bolt|plate|frame|nut"), context.rlike("standard|promo")
    kind = F.when(structural, "structural").when(regulatory, "regulatory").when(name.rlike("ing$|tion$"), "procedural").otherwise("abstract")
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("concept_type"), F.when(structural, 0.9).when(regulatory, 0.8).otherwise(0.5).alias("confidence"))


@query("coreference_gates", [253], rf"""WITH {CLAIMS_SQL}, s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, claim_text, list_distinct(regexp_extract_all(claim_text, '[\p{{L}}]{{8,}}')) AS c FROM claims),
g AS (SELECT doc_id, i, lower(split_part(claim_text, ' ', 1)) AS pronoun, coalesce(lag(c, 1) OVER w, []) AS c1, coalesce(lag(c, 2) OVER w, []) AS c2 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, i::BIGINT AS sentence, pronoun, CASE WHEN len(c1) = 1 THEN 'resolve' WHEN len(c1) = 0 AND len(c2) = 1 THEN 'resolve_far' WHEN len(c1) = 0 AND len(c2) = 0 THEN 'no_candidate' ELSE 'abstain' END AS decision, CASE WHEN len(c1) = 1 THEN c1[1] WHEN len(c1) = 0 AND len(c2) = 1 THEN c2[1] ELSE '' END AS antecedent FROM g WHERE pronoun IN ('it', 'this', 'that', 'il', 'elle', 'es', 'sie', 'esto')""")
def coreference_gates(spark, sf_dir):
    """Sentences that begin with a pronoun: resolved only if the one or two sentences before leave a single candidate, else left alone."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    long_words = F.array_distinct(F.regexp_extract_all("claim_text", F.lit(r"[\p{L}]{8,}"), F.lit(0)))
    own = claims(spark, sf_dir).select("doc_id", F.row_number().over(w).cast("long").alias("sentence"), F.lower(F.element_at(F.split("claim_text", " "), 1)).alias("pronoun"), F.col("pos"), long_words.alias("c"))
    before = lambda k: F.coalesce(F.lag("c", k).over(w), F.array().cast("array<string>"))
    own = own.select("doc_id", "sentence", "pronoun", before(1).alias("c1"), before(2).alias("c2")).filter(F.col("pronoun").isin("it", "this", "that", "il", "elle", "es", "sie", "esto"))
    n1, n2 = F.size("c1"), F.size("c2")
    decision = F.when(n1 == 1, "resolve").when((n1 == 0) & (n2 == 1), "resolve_far").when((n1 == 0) & (n2 == 0), "no_candidate").otherwise("abstain")
    return own.select("doc_id", "sentence", "pronoun", decision.alias("decision"), F.when(n1 == 1, F.col("c1")[0]).when((n1 == 0) & (n2 == 1), F.col("c2")[0]).otherwise("").alias("antecedent"))


@query("cross_references", [255], """WITH t AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS section, 'as stated, see §' || (l_partkey % 9 + 1) || ' and §' || (l_suppkey % 7 + 1) AS body FROM lineitem), r AS (SELECT DISTINCT doc, section, unnest(regexp_extract_all(body, '§([0-9]+)', 1))::BIGINT AS target FROM t), s AS (SELECT DISTINCT doc, section FROM t)
SELECT r.doc, r.section, r.target, s.section IS NOT NULL AS resolved, r.section = r.target AS own FROM r LEFT JOIN s ON r.doc = s.doc AND r.target = s.section""")
def cross_references(spark, sf_dir):
    """References to other sections in a text, resolved within the document."""
    body = F.concat(F.lit("as stated, see §"), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit(" and §"), (F.col("l_suppkey") % 7 + 1).cast("string"))
    texts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("section"), body.alias("body"))
    refs = texts.select("doc", "section", F.explode(F.regexp_extract_all("body", F.lit("§([0-9]+)"), F.lit(1))).alias("target")).withColumn("target", F.col("target").cast("long")).distinct()
    known = texts.select("doc", F.col("section").alias("target")).distinct().withColumn("found", F.lit(True))
    return refs.join(known, ["doc", "target"], "left").select("doc", "section", "target", F.coalesce("found", F.lit(False)).alias("resolved"), (F.col("section") == F.col("target")).alias("own"))


@query("marker_listing", [91], f"""WITH {AXES_SQL} SELECT upper(trim(value)) AS marker, count(DISTINCT axis)::BIGINT AS docs, min(CASE WHEN regexp_matches(value, '^[0-9]{{3,4}}$') THEN 'numeric_code' WHEN regexp_matches(value, '^[vV]?[0-9]+[.][0-9]+') THEN 'version' WHEN regexp_matches(value, 'FPS[0-9]+') THEN 'fps' WHEN regexp_matches(lower(value), '^(standard|enterprise|basic|premium)$') THEN 'edition' ELSE 'unknown' END) AS kind FROM axes GROUP BY 1""")
def marker_listing(spark, sf_dir):
    """Markers with the documents that have them, and their kind by pattern; numbers of four digits are codes before they are years."""
    value = F.col("value")
    kind = F.when(value.rlike("^[0-9]{3,4}$"), "numeric_code").when(value.rlike("^[vV]?[0-9]+[.][0-9]+"), "version").when(value.rlike("FPS[0-9]+"), "fps").when(F.lower(value).rlike("^(standard|enterprise|basic|premium)$"), "edition").otherwise("unknown")
    return axes(spark, sf_dir).groupBy(F.upper(F.trim(value)).alias("marker")).agg(F.countDistinct("axis").alias("docs"), F.min(kind).alias("kind"))
