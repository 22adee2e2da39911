"""Typed values of statements: parsing, comparison, verdicts over several claims, equal quantities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import values as V
from ..sources.statements import STATEMENTS_SQL, statements
from ..sources.tables import read
from .registry import query

PARSED_SQL = rf"""{STATEMENTS_SQL}, parsed AS (SELECT *, CASE WHEN starts_with(object_text, 'at most') THEN 'at_most' WHEN starts_with(object_text, 'at least') THEN 'at_least' WHEN starts_with(object_text, 'one of') THEN 'set'
    WHEN starts_with(object_text, 'between') THEN 'interval' WHEN starts_with(object_text, 'version') THEN 'version' WHEN starts_with(object_text, 'is ') THEN 'boolean' WHEN starts_with(object_text, 'colour') THEN 'text' ELSE 'scalar' END AS kind,
  list_transform(regexp_extract_all(object_text, '[0-9]+'), lambda x: x::DOUBLE) AS n FROM statements)"""
PREVIOUS_SQL = f"""{PARSED_SQL}, pairs AS (SELECT *, lag(kind) OVER w AS c_kind, lag(n) OVER w AS c_n, lag(object_text) OVER w AS c_text
  FROM parsed WINDOW w AS (PARTITION BY subject ORDER BY stated_at, order_id, line, source_doc, object_text, hedge))"""


def previous(spark, sf_dir):
    """Each statement with the one before it about the same part, parsed: a and c. A statement is parsed once, for both pairs that it is in."""
    w = Window.partitionBy("subject").orderBy("stated_at", "order_id", "line", "source_doc", "object_text", "hedge")
    own = statements(spark, sf_dir)
    told = own.withColumn("c_text", F.lag("object_text").over(w)).withColumn("a", V.parse(F.col("object_text")))  # after the shuffle, which carries texts
    return told.withColumn("c", F.lag("a").over(w)).filter("c_text is not null")


@query("value_parse", [203, 204, 205, 206], f"""WITH {PARSED_SQL} SELECT kind, count(*)::BIGINT AS n, sum(CASE kind WHEN 'at_most' THEN n[1] WHEN 'interval' THEN n[2] WHEN 'scalar' THEN n[1] ELSE 0 END)::BIGINT AS highs,
  sum(CASE WHEN kind = 'set' THEN len(n) ELSE 0 END)::BIGINT AS items, sum(CASE WHEN kind = 'version' THEN n[1] * 100 + n[2] * 10 + n[3] ELSE 0 END)::BIGINT AS versions, count(DISTINCT CASE WHEN kind IN ('at_most', 'at_least', 'interval', 'set', 'scalar') THEN regexp_extract(object_text, '([^ ]+)$', 1) END)::BIGINT AS units FROM parsed GROUP BY kind""")
def value_parse(spark, sf_dir):
    """What kinds of values statements have: inequality, set, interval, version, boolean, scalar or text, in this order."""
    own = statements(spark, sf_dir).select(V.parse(F.col("object_text")).alias("v")).groupBy(F.col("v.kind").alias("kind"))
    version = F.aggregate("v.version", F.lit(0), lambda a, x: a * 10 + x)
    return own.agg(
        F.count("*").alias("n"), F.sum(F.coalesce("v.high", F.lit(0.0))).cast("long").alias("highs"), F.sum(F.coalesce(F.size(F.coalesce("v.items", F.array())), F.lit(0))).alias("items"),
        F.sum(F.coalesce(version, F.lit(0))).alias("versions"), F.countDistinct("v.unit").alias("units"),
    )


@query("typed_comparison", [231, 232, 233, 234], f"""WITH {PREVIOUS_SQL}, x AS (SELECT kind AS a, c_kind AS c, n AS an, c_n AS cn, object_text, c_text, CASE WHEN authority = 'HIGH' OR scope <> 'A' THEN 0.0 ELSE least(0.05 * (1 + 0.5 * hedge), 0.1) END AS tol FROM pairs WHERE c_kind IS NOT NULL)
SELECT a, c, verdict, count(*)::BIGINT AS pairs FROM (SELECT a, c, CASE
  WHEN a = 'scalar' AND c = 'scalar' THEN CASE WHEN abs(an[1] - cn[1]) / an[1] <= tol THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'scalar' AND c = 'interval' THEN CASE WHEN an[1] BETWEEN cn[1] AND cn[2] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'scalar' AND c = 'set' THEN CASE WHEN list_contains(cn, an[1]) THEN 'PARTIAL' ELSE 'CONTRADICTS' END
  WHEN a = 'scalar' AND c = 'at_most' THEN CASE WHEN an[1] <= cn[1] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'scalar' AND c = 'at_least' THEN CASE WHEN an[1] >= cn[1] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'interval' AND c = 'interval' THEN CASE WHEN abs(an[1] - cn[1]) / an[1] <= tol AND abs(an[2] - cn[2]) / an[2] <= tol THEN 'SUPPORTS' WHEN an[1] <= cn[2] AND cn[1] <= an[2] THEN 'PARTIAL' ELSE 'CONTRADICTS' END
  WHEN a = 'interval' AND c = 'scalar' THEN CASE WHEN cn[1] BETWEEN an[1] AND an[2] THEN 'PARTIAL' ELSE 'CONTRADICTS' END
  WHEN a = 'set' AND c = 'set' THEN CASE WHEN an = cn THEN 'SUPPORTS' WHEN len(list_intersect(an, cn)) > 0 THEN 'PARTIAL' ELSE 'CONTRADICTS' END
  WHEN a = 'set' AND c = 'scalar' THEN CASE WHEN list_contains(an, cn[1]) THEN 'PARTIAL' ELSE 'CONTRADICTS' END
  WHEN a IN ('at_most', 'at_least') AND c IN ('at_most', 'at_least') THEN CASE WHEN a <> c THEN 'CONTRADICTS' WHEN abs(an[1] - cn[1]) / an[1] <= tol THEN 'SUPPORTS' WHEN a = 'at_most' AND cn[1] <= an[1] THEN 'SUPPORTS' WHEN a = 'at_least' AND cn[1] >= an[1] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'at_most' AND c = 'scalar' THEN CASE WHEN cn[1] <= an[1] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'at_least' AND c = 'scalar' THEN CASE WHEN cn[1] >= an[1] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'boolean' AND c = 'boolean' THEN CASE WHEN object_text = c_text THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'version' AND c = 'version' THEN CASE WHEN an[1:2] = cn[1:2] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
  WHEN a = 'text' AND c = 'text' THEN CASE WHEN object_text = c_text THEN 'SUPPORTS' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS verdict FROM x) GROUP BY a, c, verdict""")
def typed_comparison(spark, sf_dir):
    """Each statement against the one before it on its part, by the pair of kinds."""
    own = previous(spark, sf_dir).select(
        "a", "c", V.tolerance(F.col("authority"), F.col("scope") == "A", F.col("hedge"), F.lit(0.05)).alias("tol")
    )
    verdict = V.compare(F.col("a"), F.col("c"), F.col("tol"))["verdict"]
    return own.groupBy(F.col("a.kind").alias("a"), F.col("c.kind").alias("c"), verdict.alias("verdict")).agg(F.count("*").alias("pairs"))


@query("quantity_equivalence", [149], f"""WITH {STATEMENTS_SQL}, k AS (SELECT subject, source_doc, regexp_extract(object_text, '^([0-9]+) ', 1)::DOUBLE AS v, CASE subject % 4 WHEN 0 THEN 9.8067 ELSE 1.0 END AS f, subject % 4 AS u FROM statements WHERE regexp_matches(object_text, '^[0-9]+ (kg|mm|ms)$')),
o AS (SELECT p_partkey AS subject, p_size AS s, CASE p_partkey % 4 WHEN 0 THEN 4.4482 WHEN 1 THEN 25.4 ELSE 1000.0 END AS f FROM part)
SELECT u::BIGINT AS unit, abs(v * k.f - s * o.f) <= 0.03 * greatest(v * k.f, s * o.f) AS same, count(*)::BIGINT AS pairs FROM k JOIN o USING (subject) GROUP BY 1, 2""")
def quantity_equivalence(spark, sf_dir):
    """Statements in kg, mm and ms against the part's size in lb, inch and s: equal after conversion, within 3 %."""
    said = statements(spark, sf_dir).filter(F.col("object_text").rlike("^[0-9]+ (kg|mm|ms)$"))
    other = F.when(F.col("p_partkey") % 4 == 0, " lb").when(F.col("p_partkey") % 4 == 1, " inch").otherwise(" s")
    sizes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.concat(F.col("p_size").cast("string"), other).alias("size_text"))
    same = V.equivalent(V.quantities(F.col("object_text")), V.quantities(F.col("size_text")))
    return said.join(sizes, "subject").groupBy((F.col("subject") % 4).alias("unit"), same.alias("same")).agg(F.count("*").alias("pairs"))


@query("verdict_aggregation", [98], f"""WITH {PREVIOUS_SQL}, x AS (SELECT subject, authority, scope, CASE WHEN kind = 'scalar' AND c_kind = 'scalar' THEN CASE WHEN n[1] = c_n[1] THEN 'SUPPORTS' ELSE 'CONTRADICTS' END
   WHEN kind = 'boolean' AND c_kind = 'boolean' THEN CASE WHEN object_text = c_text THEN 'SUPPORTS' ELSE 'CONTRADICTS' END WHEN kind = 'interval' AND c_kind = 'scalar' THEN CASE WHEN c_n[1] BETWEEN n[1] AND n[2] THEN 'PARTIAL' ELSE 'CONTRADICTS' END END AS verdict,
   1 - hedge AS confidence, CASE authority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank, CASE WHEN scope = 'A' THEN 1 ELSE 0 END AS scoped FROM pairs WHERE c_kind IS NOT NULL),
v AS (SELECT * FROM x WHERE verdict IS NOT NULL), b AS (SELECT subject, max(struct_pack(r := rank, s := scoped, c := confidence, v := verdict)) AS best, max(rank) AS top FROM v GROUP BY subject),
g AS (SELECT v.subject, any_value(best) AS best, max(rank) AS top, count(*) FILTER (WHERE v.verdict = best.v) - 1 AS others, bool_or(rank = top AND verdict = 'SUPPORTS') AND bool_or(rank = top AND verdict = 'CONTRADICTS') AS torn FROM v JOIN b USING (subject) GROUP BY v.subject)
SELECT subject, CASE WHEN torn THEN 'UNKNOWN' ELSE best.v END AS verdict, round(CASE WHEN torn THEN 0.5 WHEN top = 1 THEN best.c * 0.7 ELSE least(1, (best.c + least(0.2, 0.05 * others)) * CASE best.r WHEN 3 THEN 1.0 WHEN 2 THEN 0.9 ELSE 0.8 END) END, 6) AS confidence FROM g""")
def verdict_aggregation(spark, sf_dir):
    """One verdict for each part: the claim of the highest authority, scope and confidence; torn top authorities give UNKNOWN."""
    own = previous(spark, sf_dir).select("subject", "authority", "scope", "hedge", "a", "c")
    known = F.concat_ws(" ", "a.kind", "c.kind").isin("scalar scalar", "boolean boolean", "interval scalar")
    rank = F.when(F.col("authority") == "HIGH", 3).when(F.col("authority") == "MEDIUM", 2).otherwise(1)
    judged = own.filter(known).select(
        "subject", V.compare(F.col("a"), F.col("c"), F.lit(0.0))["verdict"].alias("verdict"), rank.alias("rank"), (F.col("scope") == "A").cast("int").alias("scoped"), (1 - F.col("hedge")).alias("confidence")
    )
    counts = judged.groupBy("subject", "rank", "verdict").agg(F.count("*").alias("n"), F.max(F.struct("rank", "scoped", "confidence", "verdict")).alias("best"))
    lists = counts.groupBy("subject").agg(F.max("best").alias("best"), F.collect_list(F.struct("rank", "verdict", "n")).alias("seen"))
    top, said = F.col("best.rank"), F.col("best.verdict")
    at_top = lambda v: F.exists("seen", lambda s: (s["rank"] == top) & (s["verdict"] == v))
    others = F.aggregate(F.filter("seen", lambda s: s["verdict"] == said), F.lit(0).cast("long"), lambda t, s: t + s["n"]) - 1
    torn = at_top("SUPPORTS") & at_top("CONTRADICTS")
    weight = F.when(top == 3, 1.0).when(top == 2, 0.9).otherwise(0.8)
    sure = F.when(torn, 0.5).when(top == 1, F.col("best.confidence") * 0.7).otherwise(F.least(F.lit(1.0), (F.col("best.confidence") + F.least(F.lit(0.2), 0.05 * others)) * weight))
    return lists.select("subject", F.when(torn, "UNKNOWN").otherwise(said).alias("verdict"), F.round(sure, 6).alias("confidence"))


@query("set_values", [134], f"""WITH {PARSED_SQL}, s AS (SELECT subject, list(DISTINCT x) AS all_items FROM (SELECT subject, unnest(n) AS x FROM parsed WHERE kind = 'set') GROUP BY subject)
SELECT p.subject, count(*)::BIGINT AS sets, min(len(all_items) - len(list_distinct(n)))::BIGINT AS least_missing, bool_or(len(list_distinct(n)) = len(all_items)) AS complete FROM parsed p JOIN s USING (subject) WHERE kind = 'set' GROUP BY p.subject""")
def set_values(spark, sf_dir):
    """How much each stated set lacks of all that is stated about its part: set difference inside a value."""
    own = statements(spark, sf_dir).select("subject", V.parse(F.col("object_text")).alias("v")).filter("v.kind = 'set'").select("subject", "v.items")
    every = own.select("subject", F.explode("items").alias("x")).groupBy("subject").agg(F.collect_set("x").alias("every"))
    missing = F.size(F.array_except("every", "items"))
    return own.join(every, "subject").groupBy("subject").agg(F.count("*").alias("sets"), F.min(missing).cast("long").alias("least_missing"), F.bool_or(missing == 0).alias("complete"))


@query("truth_regimes", [236], f"""WITH {PARSED_SQL} SELECT CASE WHEN kind IN ('at_most', 'at_least') THEN 'NORMATIVE_BOUNDED' WHEN kind IN ('boolean', 'version') THEN 'NORMATIVE_STRICT' WHEN kind = 'text' THEN 'TEXTUAL' WHEN kind = 'scalar' AND hedge >= 0.05 THEN 'DESCRIPTIVE_APPROX' ELSE 'EMPIRICAL_STATISTICAL' END AS regime,
  kind AS form, count(*)::BIGINT AS n, round(avg(CASE WHEN authority <> 'HIGH' AND kind = 'scalar' AND hedge >= 0.05 THEN least(0.05 * (1 + 0.5 * hedge), 0.1) ELSE 0 END), 6) AS tolerance FROM parsed GROUP BY 1, 2""")
def truth_regimes(spark, sf_dir):
    """A statement's form and the regime in which it is true, with the mean tolerance that this allows."""
    own = statements(spark, sf_dir).select("authority", "hedge", V.kind_of(F.col("object_text")).alias("form"))
    approximate = (F.col("form") == "scalar") & (F.col("hedge") >= 0.05)
    regime = (
        F.when(F.col("form").isin("at_most", "at_least"), "NORMATIVE_BOUNDED")
        .when(F.col("form").isin("boolean", "version"), "NORMATIVE_STRICT")
        .when(F.col("form") == "text", "TEXTUAL")
        .when(approximate, "DESCRIPTIVE_APPROX")
        .otherwise("EMPIRICAL_STATISTICAL")
    )
    allowed = V.tolerance(F.col("authority"), approximate, F.col("hedge"), F.lit(0.05))
    return own.groupBy(regime.alias("regime"), "form").agg(F.count("*").alias("n"), F.round(F.avg(allowed), 6).alias("tolerance"))


@query("value_contradiction_filter", [237, 239], f"""WITH {PREVIOUS_SQL}, x AS (SELECT *, CASE WHEN kind IN ('scalar', 'at_most', 'at_least', 'interval', 'set') THEN 'NUMBER' WHEN kind = 'version' THEN 'VERSION' ELSE 'UNTYPED' END AS f, CASE WHEN c_kind IN ('scalar', 'at_most', 'at_least', 'interval', 'set') THEN 'NUMBER' WHEN c_kind = 'version' THEN 'VERSION' ELSE 'UNTYPED' END AS g FROM pairs WHERE c_kind IS NOT NULL)
SELECT outcome, rule, count(*)::BIGINT AS pairs FROM (SELECT CASE WHEN f = 'UNTYPED' OR g = 'UNTYPED' THEN 'COMPATIBLE' WHEN f <> g THEN 'INCOMPARABLE' WHEN n[1] = c_n[1] AND (f <> 'VERSION' OR n = c_n) THEN 'COMPATIBLE' ELSE 'NEED_MODEL' END AS outcome,
  CASE WHEN (kind = 'at_most' AND c_kind = 'at_least') OR (kind = 'at_least' AND c_kind = 'at_most') THEN 'COMPLEMENTARY' ELSE 'none' END AS rule FROM x) GROUP BY 1, 2""")
def value_contradiction_filter(spark, sf_dir):
    """Which pairs of statements need a model at all: by frame, unit and first value; at most against at least only complete each other."""
    own = previous(spark, sf_dir).select("a", "c")
    frame = lambda v: F.when(F.col(f"{v}.kind").isin("scalar", "at_most", "at_least", "interval", "set"), "NUMBER").when(F.col(f"{v}.kind") == "version", "VERSION").otherwise("UNTYPED")
    first = lambda v: F.coalesce(F.col(f"{v}.low"), F.element_at(f"{v}.items", 1), F.col(f"{v}.high"))
    same = F.when(frame("a") == "VERSION", F.col("a.version") == F.col("c.version")).otherwise(first("a") == first("c"))
    outcome = F.when((frame("a") == "UNTYPED") | (frame("c") == "UNTYPED"), "COMPATIBLE").when(frame("a") != frame("c"), "INCOMPARABLE").when(same, "COMPATIBLE").otherwise("NEED_MODEL")
    opposed = F.concat_ws(" ", "a.kind", "c.kind").isin("at_most at_least", "at_least at_most")
    return own.groupBy(outcome.alias("outcome"), F.when(opposed, "COMPLEMENTARY").otherwise("none").alias("rule")).agg(F.count("*").alias("pairs"))


@query("exclusive_predicates", [238], f"""WITH {PARSED_SQL}, p AS (SELECT kind, subject, count(DISTINCT object_text) AS objects, count(*) AS n FROM parsed GROUP BY kind, subject)
SELECT kind AS predicate, count(*)::BIGINT AS subjects, round(avg(CASE WHEN objects > 1 THEN 1.0 ELSE 0.0 END), 6) AS several, avg(CASE WHEN objects > 1 AND n > 1 THEN 1.0 ELSE 0.0 END) < 0.5 AS exclusive FROM p WHERE n > 1 GROUP BY kind""")
def exclusive_predicates(spark, sf_dir):
    """Which predicates have one object for a subject: judged by the subjects that state it more than once."""
    own = statements(spark, sf_dir).groupBy(V.kind_of(F.col("object_text")).alias("predicate"), "subject")
    own = own.agg(F.countDistinct("object_text").alias("objects"), F.count("*").alias("n")).filter("n > 1")
    several = F.avg((F.col("objects") > 1).cast("double"))
    return own.groupBy("predicate").agg(F.count("*").alias("subjects"), F.round(several, 6).alias("several"), (several < 0.5).alias("exclusive"))
