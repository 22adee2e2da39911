"""Entity resolution on names: keys, blocking, pair signals, scores, routes, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import resolver as R
from ..sources.tables import read
from .registry import query

NAMES_SQL = r"""names AS (SELECT name, count(*) AS support, split_part(name, ' ', 1) AS block, regexp_extract_all(lower(name), '[a-z0-9]+') AS toks FROM (
  SELECT p_brand || ' ' || p_name AS name FROM part) GROUP BY name)"""
PAIRS_SQL = f"""{NAMES_SQL}, pairs AS (SELECT a.name AS a, b.name AS b, a.support + b.support AS support,
  len(list_intersect(a.toks, b.toks))::DOUBLE / len(list_distinct(a.toks || b.toks)) AS jac, 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS lev
  FROM names a JOIN names b ON a.block = b.block AND a.name < b.name)"""


def names(spark, sf_dir):
    own = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).groupBy("name").agg(F.count("*").alias("support"))
    return own.withColumn("block", F.element_at(F.split("name", " "), 1)).withColumn("toks", T.tokens(F.col("name")))


def pairs(spark, sf_dir):
    """Pairs of different names of a block (the brand): an equi-join on the block's names, each once."""
    one, two = names(spark, sf_dir).alias("x"), names(spark, sf_dir).alias("y")
    both = one.join(two, (F.col("x.block") == F.col("y.block")) & (F.col("x.name") < F.col("y.name")))
    lev = 1 - F.levenshtein("x.name", "y.name") / F.greatest(F.length("x.name"), F.length("y.name"))
    return both.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), (F.col("x.support") + F.col("y.support")).alias("support"), T.jaccard(F.col("x.toks"), F.col("y.toks")).alias("jac"), lev.alias("lev"))


@query("normal_keys", [81, 159, 168], r"""SELECT regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '([a-z]{3,})s\b', '\1', 'g') AS key, count(*)::BIGINT AS parts, count(DISTINCT p_name)::BIGINT AS variants FROM part GROUP BY 1""")
def normal_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(T.normal_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("parts"), F.countDistinct("p_name").alias("variants"))


@query("blocked_pairs", [73, 141, 143], f"WITH {PAIRS_SQL} SELECT a, b, round(jac, 6) AS jaccard, round(lev, 6) AS levenshtein FROM pairs")
def blocked_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("a", "b", F.round("jac", 6).alias("jaccard"), F.round("lev", 6).alias("levenshtein"))


@query("name_similarity", [144], f"WITH {PAIRS_SQL} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM pairs WHERE lev >= 0.6")
def name_similarity(spark, sf_dir):
    from ..functions.strings import jaro_winkler_udf
    from ..session import ship_package

    ship_package(spark)
    own = pairs(spark, sf_dir).filter("lev >= 0.6")
    return own.select("a", "b", F.round(jaro_winkler_udf("a", "b"), 6).alias("similarity"))


SCORED_SQL = f"""{PAIRS_SQL}, scored AS (SELECT a, b, support, (CASE WHEN jac > 0 THEN 0.4 * jac ELSE 0 END + CASE WHEN lev > 0 THEN 0.6 * lev ELSE 0 END)
  / nullif(CASE WHEN jac > 0 THEN 0.4 ELSE 0 END + CASE WHEN lev > 0 THEN 0.6 ELSE 0 END, 0) AS score FROM pairs)"""


def scored(spark, sf_dir):
    """The weighted mean over the signals that are above zero."""
    own = pairs(spark, sf_dir)
    part = lambda c, w: F.when(F.col(c) > 0, w).otherwise(0.0)
    weight = part("jac", 0.4) + part("lev", 0.6)
    score = (part("jac", 0.4) * F.col("jac") + part("lev", 0.6) * F.col("lev")) / F.nullif(weight, F.lit(0.0))
    return own.select("a", "b", "support", score.alias("score"))


@query("pair_routes", [151, 152, 153], f"""WITH {SCORED_SQL} SELECT a, b, round(score, 6) AS score,
  CASE WHEN round(score, 6) >= 0.8 THEN 'AUTO' WHEN round(score, 6) >= 0.6 AND support >= 4 THEN 'DEFER' ELSE 'REJECT' END AS route FROM scored""")
def pair_routes(spark, sf_dir):
    score = F.round("score", 6)
    route = F.when(score >= 0.8, "AUTO").when((score >= 0.6) & (F.col("support") >= 4), "DEFER").otherwise("REJECT")
    return scored(spark, sf_dir).select("a", "b", score.alias("score"), route.alias("route"))


@query("merge_groups", [139, 349], f"""WITH RECURSIVE {SCORED_SQL}, e AS (SELECT a, b FROM scored WHERE round(score, 6) >= 0.8), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT a AS node, a AS other FROM u UNION SELECT walk.node, u.b FROM walk JOIN u ON walk.other = u.a)
SELECT node AS name, min(other) AS canonical FROM walk GROUP BY node""")
def merge_groups(spark, sf_dir):
    links = scored(spark, sf_dir).filter(F.round("score", 6) >= 0.8).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return G.components(links).select(F.col("node").alias("name"), F.col("component").alias("canonical"))


@query("mutual_best", [117], f"""WITH {SCORED_SQL}, s AS (SELECT a AS x, b AS y, score FROM scored UNION ALL SELECT b, a, score FROM scored),
b AS (SELECT x, y FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(score, 6) DESC, y) = 1)
SELECT p.x AS a, p.y AS b FROM b p JOIN b q ON p.x = q.y AND p.y = q.x WHERE p.x < p.y""")
def mutual_best(spark, sf_dir):
    """Pairs in which each is the other's best: kept once where a pair is best from both ends."""
    own = scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    ends = own.select(F.col("a").alias("x"), F.col("b").alias("y"), "score").unionByName(own.select(F.col("b").alias("x"), F.col("a").alias("y"), "score"))
    w = Window.partitionBy("x").orderBy(F.desc("score"), "y")
    best = ends.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return best.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n")).filter("n = 2").drop("n")


@query("subject_resolution", [162, 163], """SELECT c_custkey, coalesce(e.n_name, CASE WHEN c_nationkey % 2 = 0 THEN 'even ' || r_name END, 'unresolved') AS subject FROM customer
 LEFT JOIN (SELECT * FROM nation WHERE n_name < 'K') e ON c_nationkey = e.n_nationkey LEFT JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN region ON n.n_regionkey = r_regionkey""")
def subject_resolution(spark, sf_dir):
    """A cascade: exact name, then a wider scope, else unresolved."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    known = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.when(F.col("n_name") < "K", F.col("n_name")).alias("exact"), "r_name")
    both = read(spark, sf_dir, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    wider = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("even "), "r_name"))
    return both.select("c_custkey", F.coalesce("exact", wider, F.lit("unresolved")).alias("subject"))


@query("incremental_resolver", [360], """WITH RECURSIVE k AS (SELECT p_partkey AS item, p_name || '|' || p_brand AS key FROM part UNION ALL SELECT p_partkey, p_brand || '|' || p_type || '|' || p_size FROM part),
e AS (SELECT DISTINCT a.item AS a, b.item AS b FROM k a JOIN k b USING (key)), walk AS (SELECT a AS node, b AS other FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON walk.other = e.a)
SELECT node AS item, min(other) AS cluster FROM walk GROUP BY node""")
def incremental_resolver(spark, sf_dir):
    """Parts that share name and brand, or brand, type and size, are one concept; four batches come one by one and join the clusters that are there."""
    part = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    keys = F.array(F.concat_ws("|", "p_name", "p_brand"), F.concat_ws("|", "p_brand", "p_type", size))
    rows = part.select(F.col("p_partkey").alias("item"), F.explode(keys).alias("key"))
    store = R.ConceptStore(spark)
    for n in range(4):
        store.insert(rows.filter(F.pmod(F.xxhash64("item"), F.lit(4)) == n))
    return store.resolve(rows)
