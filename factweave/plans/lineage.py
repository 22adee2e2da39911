"""Versions and lineage: axis orders, revisions, what changed between versions, chains, replaced claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ordering as O
from ..operators import temporal as X
from ..sources.statements import STATEMENTS_SQL, statements
from ..sources.tables import read
from .graph import EDGES_SQL, STRONG_SQL, edges, strong
from .registry import query

AXES_SQL = """axes AS (SELECT DISTINCT axis, value FROM (SELECT 'release ' || (p_partkey % 20) AS axis, (p_size % 5) || '.' || (p_partkey % 7) || CASE WHEN p_size % 2 = 0 THEN '.' || (p_size % 4) ELSE '' END AS value FROM part
  UNION ALL SELECT 'year ' || (p_partkey % 20), (2000 + p_size)::VARCHAR FROM part UNION ALL SELECT 'pack ' || (p_partkey % 20), (2000 + p_size % 6) || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' FPS0' || (p_size % 3) END FROM part
  UNION ALL SELECT 'part ' || (p_partkey % 20), p_size::VARCHAR FROM part UNION ALL SELECT 'chapter ' || (p_partkey % 20), list_extract(['I', 'II', 'III', 'IV', 'V', 'VI'], (p_size % 6 + 1)::BIGINT) FROM part
  UNION ALL SELECT 'issue ' || (p_partkey % 20), list_extract(['first', 'Second', 'third', 'fourth'], (p_size % 4 + 1)::BIGINT) FROM part UNION ALL SELECT 'edition ' || (p_partkey % 20), list_extract(['standard', 'enterprise', 'Basic', 'premium'], (p_size % 4 + 1)::BIGINT) FROM part
  UNION ALL SELECT 'name ' || (p_partkey % 20), p_name FROM part))"""


def axes(spark, sf_dir):
    """Axes with values of different kinds, from parts: axis, value, each pair once."""
    parts, size, g = read(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey") % 20
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (size % len(words) + 1).cast("int"))
    kinds = {
        "release": text(size % 5, ".", F.col("p_partkey") % 7, F.when(size % 2 == 0, text(".", size % 4)).otherwise("")),
        "year": text(2000 + size),
        "pack": text(2000 + size % 6, F.when(size % 3 == 0, "").otherwise(text(" FPS0", size % 3))),
        "part": text(size),
        "chapter": pick(["I", "II", "III", "IV", "V", "VI"]),
        "issue": pick(["first", "Second", "third", "fourth"]),
        "edition": pick(["standard", "enterprise", "Basic", "premium"]),
        "name": F.col("p_name"),
    }
    pairs = F.explode(F.array(*[F.struct(text(f"{k} ", g).alias("axis"), v.alias("value")) for k, v in kinds.items()]))
    return parts.select(pairs.alias("p")).select("p.axis", "p.value").distinct()


@query("axis_value_orders", [127], f"""WITH {AXES_SQL}, n AS (SELECT axis, count(*) AS n FROM axes GROUP BY axis), k AS (SELECT axis, value, split_part(axis, ' ', 1) AS kind, CASE split_part(axis, ' ', 1)
   WHEN 'release' THEN split_part(value, '.', 1)::DOUBLE * 1e12 + split_part(value, '.', 2)::DOUBLE * 1e6 + coalesce(TRY_CAST(split_part(value, '.', 3) AS DOUBLE), 0) WHEN 'year' THEN value::DOUBLE
   WHEN 'pack' THEN split_part(value, ' ', 1)::DOUBLE * 1000 + coalesce(TRY_CAST(replace(split_part(value, ' ', 2), 'FPS', '') AS DOUBLE), 0) WHEN 'part' THEN value::DOUBLE
   WHEN 'chapter' THEN list_position(['I', 'II', 'III', 'IV', 'V', 'VI'], value)::DOUBLE WHEN 'issue' THEN list_position(['first', 'second', 'third', 'fourth'], lower(value))::DOUBLE
   WHEN 'edition' THEN list_position(['basic', 'standard', 'professional', 'premium', 'enterprise'], lower(value))::DOUBLE END AS key FROM axes)
SELECT axis, value, CASE WHEN n < 2 OR kind = 'name' THEN 'unknown' ELSE CASE kind WHEN 'release' THEN 'semver' WHEN 'pack' THEN CASE WHEN bool_and(NOT contains(value, ' ')) OVER (PARTITION BY axis) THEN 'year' ELSE 'year_pack' END WHEN 'part' THEN 'numeric' WHEN 'chapter' THEN 'roman' WHEN 'issue' THEN 'ordinal' ELSE kind END END AS strategy,
  CASE WHEN n < 2 OR kind = 'name' THEN 'UNKNOWN' WHEN kind IN ('chapter', 'issue', 'edition') THEN 'INFERRED' ELSE 'CERTAIN' END AS confidence,
  CASE WHEN n < 2 OR kind = 'name' THEN 0 ELSE row_number() OVER (PARTITION BY axis ORDER BY key, value) END::BIGINT AS place FROM k JOIN n USING (axis)""")
def axis_value_orders(spark, sf_dir):
    """The order of each axis's values: versions, years, years with packs, numbers, roman numerals, ordinal words, editions; else none."""
    own = O.infer_order(axes(spark, sf_dir), "axis", "value")
    place = F.when(F.col("strategy") == "unknown", 0).otherwise(F.row_number().over(Window.partitionBy("axis").orderBy("key", "value")))
    return own.select("axis", "value", "strategy", "confidence", place.cast("long").alias("place"))


REVISIONS_SQL = """keys AS (SELECT DISTINCT s_suppkey AS doc, (s_suppkey % 10)::BIGINT AS authority, 'AC ' || (20 + s_suppkey % 10) || '-' || (s_suppkey // 10 % 5) || list_extract(['', 'A', 'B', 'C'], (s_suppkey // 50 % 4 + 1)::BIGINT) AS reg_key,
  CAST(TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * ((s_suppkey * 37) % 1000)::INTEGER AS TIMESTAMP) AS issued FROM supplier)"""


def regulatory_keys(spark, sf_dir):
    """Suppliers as documents with a regulatory key, its authority and a date."""
    n = F.col("s_suppkey")
    letter = F.element_at(F.array(*map(F.lit, ("", "A", "B", "C"))), (F.floor(n / 50) % 4 + 1).cast("int"))
    key = F.concat(F.lit("AC "), (20 + n % 10).cast("string"), F.lit("-"), (F.floor(n / 10) % 5).cast("string"), letter)
    issued = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((n * 37 % 1000).cast("int"))
    return read(spark, sf_dir, "supplier").select(n.alias("doc"), (n % 10).alias("authority"), key.alias("reg_key"), issued.alias("issued")).distinct()


LINEAGE_SQL = rf"""{REVISIONS_SQL}, fam AS (SELECT *, CASE WHEN regexp_matches(reg_key, '[0-9][A-Z]$') THEN left(reg_key, length(reg_key) - 1) ELSE reg_key END AS base, CASE WHEN regexp_matches(reg_key, '[0-9][A-Z]$') THEN right(reg_key, 1) ELSE '' END AS rev FROM keys),
pair AS (SELECT doc AS older, lead(doc) OVER w AS newer, rev, lead(rev) OVER w AS next_rev, issued, lead(issued) OVER w AS next_issued, base FROM fam WINDOW w AS (PARTITION BY base, authority ORDER BY rev, issued, doc))"""


@query("revision_lineage", [128, 246], f"""WITH {LINEAGE_SQL} SELECT newer, older, base, rev, next_rev, 0.85::DOUBLE AS confidence FROM pair WHERE newer IS NOT NULL AND next_rev > rev AND next_issued > issued""")
def revision_lineage(spark, sf_dir):
    """Adjacent revisions of one base and authority: the later supersedes if letter and date agree."""
    return lineage_pairs(spark, sf_dir).select("newer", "older", "base", "rev", "next_rev", F.lit(0.85).alias("confidence"))


def lineage_pairs(spark, sf_dir):
    own = regulatory_keys(spark, sf_dir).withColumn("base", O.family(F.col("reg_key"))).withColumn("rev", O.revision(F.col("reg_key")))
    w = Window.partitionBy("base", "authority").orderBy("rev", "issued", "doc")
    pair = own.select(F.col("doc").alias("older"), F.lead("doc").over(w).alias("newer"), "rev", F.lead("rev").over(w).alias("next_rev"), "issued", F.lead("issued").over(w).alias("next_issued"), "base")
    return pair.filter("newer is not null and next_rev > rev and next_issued > issued")


@query("superseded_claims", [246, 258], f"""WITH RECURSIVE {LINEAGE_SQL}, e AS (SELECT newer, older FROM pair WHERE newer IS NOT NULL AND next_rev > rev AND next_issued > issued), walk AS (SELECT newer, older, 1 AS hops FROM e UNION ALL SELECT walk.newer, e.older, hops + 1 FROM walk JOIN e ON walk.older = e.newer WHERE hops < 4),
c AS (SELECT l_partkey AS subject, l_suppkey AS doc, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT a.subject, newer, older, min(hops)::BIGINT AS hops, any_value(b.n)::BIGINT AS superseded FROM walk JOIN c a ON a.doc = newer JOIN c b ON b.doc = older AND a.subject = b.subject GROUP BY a.subject, newer, older""")
def superseded_claims(spark, sf_dir):
    """Claims on one subject from two documents that a path of up to four lineage edges joins: the older document's are superseded."""
    step = lineage_pairs(spark, sf_dir).select("newer", "older")
    path, frontier = step.withColumn("hops", F.lit(1)), step.withColumn("hops", F.lit(1))
    onward = step.select(F.col("newer").alias("older"), F.col("older").alias("next"))
    for _ in range(3):
        frontier = frontier.join(onward, "older").select("newer", F.col("next").alias("older"), (F.col("hops") + 1).alias("hops"))
        path = path.unionByName(frontier)
    path = path.groupBy("newer", "older").agg(F.min("hops").cast("long").alias("hops"))
    claims = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("doc")).agg(F.count("*").alias("n"))
    new = claims.select("subject", F.col("doc").alias("newer"))
    old = claims.select("subject", F.col("doc").alias("older"), F.col("n").alias("superseded"))
    return path.join(new, "newer").join(old, ["subject", "older"]).select("subject", "newer", "older", "hops", "superseded")


VERSIONS_SQL = f"""{STATEMENTS_SQL}, spo AS (SELECT subject, scope AS predicate, object_text AS object, CASE WHEN year(stated_at) < 1999 THEN 'old' ELSE 'new' END AS side, count(*) AS n FROM statements WHERE line <> 7 GROUP BY ALL),
fp AS (SELECT subject, predicate, object, coalesce(max(n) FILTER (WHERE side = 'old'), 0) AS o, coalesce(max(n) FILTER (WHERE side = 'new'), 0) AS w FROM spo GROUP BY ALL),
rest AS (SELECT subject, predicate, sum(least(o, w)) AS unchanged, sum(o - least(o, w)) AS o_left, sum(w - least(o, w)) AS w_left FROM fp GROUP BY ALL)"""


@query("version_claim_diff", [131, 137], f"""WITH {VERSIONS_SQL} SELECT subject, predicate, unchanged::BIGINT AS unchanged, CASE WHEN o_left = 1 AND w_left = 1 THEN 1 ELSE 0 END::BIGINT AS modified,
  CASE WHEN o_left = 1 AND w_left = 1 THEN 0 ELSE w_left END::BIGINT AS added, CASE WHEN o_left = 1 AND w_left = 1 THEN 0 ELSE o_left END::BIGINT AS removed FROM rest""")
def version_claim_diff(spark, sf_dir):
    """Claims of an old and a new version by subject, predicate and object: equal triples pair off one to one and are unchanged; where
    just one is left on each side of a subject and predicate it is modified; all others are added or removed. Counts stand for the pairs."""
    own = statements(spark, sf_dir).filter("line != 7")
    old = F.year("stated_at") < 1999
    triples = own.groupBy("subject", F.col("scope").alias("predicate"), "object_text").agg(F.count_if(old).alias("o"), F.count_if(~old).alias("w"))
    same = F.least("o", "w")
    rest = triples.groupBy("subject", "predicate").agg(F.sum(same).alias("unchanged"), F.sum(F.col("o") - same).alias("o_left"), F.sum(F.col("w") - same).alias("w_left"))
    one = (F.col("o_left") == 1) & (F.col("w_left") == 1)
    left = lambda c: F.when(one, 0).otherwise(F.col(c)).cast("long")
    return rest.select("subject", "predicate", "unchanged", one.cast("long").alias("modified"), left("w_left").alias("added"), left("o_left").alias("removed"))


@query("triple_dedup", [137], f"""WITH {STATEMENTS_SQL}, k AS (SELECT *, CASE WHEN line = 7 THEN NULL ELSE lower(trim(object_text)) END AS object FROM statements)
SELECT subject, count(*)::BIGINT AS kept, round(sum(best), 4) AS confidence FROM (SELECT subject, scope, object, max(1 - hedge) AS best FROM k WHERE object IS NOT NULL GROUP BY ALL UNION ALL SELECT subject, scope, object, 1 - hedge FROM k WHERE object IS NULL) GROUP BY subject""")
def triple_dedup(spark, sf_dir):
    """Of equal triples the surest stays; rows without a whole triple all stay."""
    own = statements(spark, sf_dir).select("subject", "scope", F.when(F.col("line") != 7, F.lower(F.trim("object_text"))).alias("object"), (1 - F.col("hedge")).alias("sure"))
    best = own.filter("object is not null").groupBy("subject", "scope", "object").agg(F.max("sure").alias("sure")).select("subject", "sure")
    every = best.unionByName(own.filter("object is null").select("subject", "sure"))
    return every.groupBy("subject").agg(F.count("*").alias("kept"), F.round(F.sum("sure"), 4).alias("confidence"))


@query("claim_chains", [69], """WITH l AS (SELECT l_orderkey AS doc, 'n' || (l_partkey % 40) AS s, 'n' || (l_suppkey % 40) AS o, l_linenumber::BIGINT AS line FROM lineitem),
own AS (SELECT doc, s, o, min(line) AS line FROM l WHERE s <> o GROUP BY ALL), f AS (SELECT s, count(DISTINCT doc) AS df FROM own GROUP BY s), t AS (SELECT count(DISTINCT doc) AS docs FROM own),
j AS (SELECT a.doc, a.s, a.o AS via, b.o AS target, row_number() OVER (PARTITION BY a.doc, a.o ORDER BY a.line, b.line, a.s, b.o) AS rn FROM own a JOIN own b ON a.doc = b.doc AND a.o = b.s WHERE b.o <> a.s)
SELECT j.doc, j.s AS source, via, target, round(ln(docs::DOUBLE / df), 6) AS confidence FROM j JOIN f ON f.s = via CROSS JOIN t WHERE rn <= 10""")
def claim_chains(spark, sf_dir):
    """Within a document, a claim whose object is the subject of another: no loops, no way straight back, ten for each link, rare links surer."""
    lines = read(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 40).cast("string"))
    own = lines.select(F.col("l_orderkey").alias("doc"), name("l_partkey").alias("s"), name("l_suppkey").alias("o"), F.col("l_linenumber").alias("line"))
    own = own.filter("s != o").groupBy("doc", "s", "o").agg(F.min("line").alias("line"))
    docs = own.agg(F.countDistinct("doc").alias("docs"))
    rarity = own.groupBy("s").agg(F.countDistinct("doc").alias("df")).crossJoin(F.broadcast(docs)).select(F.col("s").alias("via"), F.round(F.log(F.col("docs") / F.col("df")), 6).alias("confidence"))
    second = own.select("doc", F.col("s").alias("via"), F.col("o").alias("target"), F.col("line").alias("line2"))
    both = own.select("doc", F.col("s").alias("source"), F.col("o").alias("via"), "line").join(second, ["doc", "via"]).filter("target != source")
    w = Window.partitionBy("doc", "via").orderBy("line", "line2", "source", "target")
    return both.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").join(rarity, "via").select("doc", "source", "via", "target", "confidence")


@query("undirected_reach", [256, 258], f"""WITH RECURSIVE {STRONG_SQL}, u AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong), q AS (SELECT DISTINCT src FROM strong WHERE src % 20 = 0),
walk AS (SELECT src AS start, src AS node, 0 AS depth FROM q UNION SELECT start, u.dst, depth + 1 FROM walk JOIN u ON walk.node = u.src WHERE depth < 3)
SELECT start, node, min(depth)::BIGINT AS depth FROM walk GROUP BY start, node""")
def undirected_reach(spark, sf_dir):
    """What every start node (ids divisible by 20) reaches in up to three steps in either direction."""
    own = strong(spark, sf_dir)
    both = G.cut(own.select("src", "dst").unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = own.filter("src % 20 = 0").select(F.col("src").alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("depth"))
    frontier = seen
    for depth in (1, 2, 3):
        new = frontier.join(both, frontier["node"] == both["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        frontier = G.cut(new.withColumn("depth", F.lit(depth).cast("long")))
        seen = seen.unionByName(frontier)
    return seen


@query("successors_and_predecessors", [65, 66], f"""WITH {STRONG_SQL}, d AS (SELECT s_suppkey AS doc FROM supplier WHERE contains(lower(s_name), '5'))
SELECT doc, 'successor' AS direction, dst AS other, round(weight, 6) AS weight FROM d JOIN strong ON src = doc UNION ALL SELECT doc, 'predecessor', src, round(weight, 6) FROM d JOIN strong ON dst = doc""")
def successors_and_predecessors(spark, sf_dir):
    """Edges in either direction of the documents whose name has a keyword: a semi-join on the documents' ids."""
    docs = read(spark, sf_dir, "supplier").filter(F.contains(F.lower("s_name"), F.lit("5"))).select(F.col("s_suppkey").alias("doc"))
    own = strong(spark, sf_dir)
    ends = own.select(F.col("src").alias("doc"), F.lit("successor").alias("direction"), F.col("dst").alias("other"), F.round("weight", 6).alias("weight")).unionByName(
        own.select(F.col("dst").alias("doc"), F.lit("predecessor").alias("direction"), F.col("src").alias("other"), F.round("weight", 6).alias("weight"))
    )
    return ends.join(docs, "doc", "left_semi")


@query("conflicts_in_document_set", [67, 336], f"""WITH {EDGES_SQL}, chosen AS (SELECT s_suppkey AS doc FROM supplier WHERE s_nationkey < 12), c AS (SELECT * FROM edges WHERE src <> dst AND n >= 2), r AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE n = 1 AND src <> dst)
SELECT least(c.src, c.dst) AS a, greatest(c.src, c.dst) AS b, count(*)::BIGINT AS conflicts, bool_or(r.a IS NOT NULL) AS resolved FROM c JOIN chosen x ON c.src = x.doc JOIN chosen y ON c.dst = y.doc LEFT JOIN r ON r.a = least(c.src, c.dst) AND r.b = greatest(c.src, c.dst) GROUP BY 1, 2""")
def conflicts_in_document_set(spark, sf_dir):
    """Conflict edges with both ends in a set of documents; a weak edge between the two, in any direction, marks it as resolved."""
    chosen = read(spark, sf_dir, "supplier").filter("s_nationkey < 12").select("s_suppkey")
    own = edges(spark, sf_dir).filter("src != dst")
    inside = own.filter("n >= 2").join(chosen.withColumnRenamed("s_suppkey", "src"), "src", "left_semi").join(chosen.withColumnRenamed("s_suppkey", "dst"), "dst", "left_semi")
    pair = (F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    solved = own.filter("n = 1").select(*pair).distinct().withColumn("solved", F.lit(True))
    counted = inside.groupBy(*pair).agg(F.count("*").alias("conflicts"))
    return counted.join(solved, ["a", "b"], "left").select("a", "b", "conflicts", F.coalesce("solved", F.lit(False)).alias("resolved"))


@query("relation_timestamps", [317], """WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, o_orderdate, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'symmetric' ELSE 'directional' END AS kind, count(*)::BIGINT AS relations, strftime(max(CASE WHEN l_linenumber % 2 = 0 THEN greatest(l_shipdate, o_orderdate) ELSE o_orderdate END), '%Y-%m-%d %H:%M:%S') AS latest,
  count(*) FILTER (WHERE l_shipdate < o_orderdate AND l_linenumber % 2 = 0)::BIGINT AS moved FROM s GROUP BY 1""")
def relation_timestamps(spark, sf_dir):
    """A symmetric relation begins when both ends hold (the later time), a directional one with its source."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber")
    both = lines.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    symmetric = F.col("l_linenumber") % 2 == 0
    starts = F.when(symmetric, F.greatest("l_shipdate", "o_orderdate")).otherwise(F.col("o_orderdate"))
    own = both.groupBy(F.when(symmetric, "symmetric").otherwise("directional").alias("kind"))
    return own.agg(F.count("*").alias("relations"), F.date_format(F.max(starts), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.count_if(symmetric & (F.col("l_shipdate") < F.col("o_orderdate"))).alias("moved"))


@query("version_at_each_date", [344, 39], """WITH d AS (SELECT DISTINCT o_custkey AS doc, o_orderdate AS at FROM orders), q AS (SELECT DISTINCT date_trunc('year', o_orderdate) AS at FROM orders)
SELECT strftime(q.at, '%Y-%m-%d %H:%M:%S') AS at, doc, strftime(max(d.at), '%Y-%m-%d %H:%M:%S') AS version FROM q JOIN d ON d.at <= q.at GROUP BY q.at, doc""")
def version_at_each_date(spark, sf_dir):
    """For every anchor date (the years' first days) each document's newest version until then: a version counts from the first anchor
    after it to the one before its successor, which is an explode over few anchors and no range join."""
    versions = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderdate").alias("at")).distinct()
    span = versions.agg(F.max(F.year("at")).alias("last"))
    following = F.lead("at").over(Window.partitionBy("doc").orderBy("at"))
    begin = F.year("at") + (F.date_trunc("year", "at") < F.col("at")).cast("int")
    own = versions.withColumn("following", following).crossJoin(F.broadcast(span))
    end = F.coalesce(F.year("following") + (F.date_trunc("year", "following") < F.col("following")).cast("int") - 1, F.col("last"))
    kept = own.select("doc", "at", begin.alias("begin"), F.least(end, F.col("last")).alias("end")).filter("begin <= end")
    years = kept.select("doc", F.col("at").alias("version"), F.explode(F.sequence("begin", "end")).alias("year"))
    known = versions.select(F.year("at").alias("year")).distinct()
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return years.join(F.broadcast(known), "year").select(stamp(F.make_timestamp_ntz("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("at"), "doc", stamp(F.col("version")).alias("version"))


CLOSING_SQL = """c AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderdate AS ordered, max(CASE WHEN o_orderstatus = 'F' THEN l_shipdate END) AS closes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
w AS (SELECT id, closes AS own, min(CASE WHEN closes IS NOT NULL THEN struct_pack(closes := closes, cause := id) END) OVER (PARTITION BY cust, year(ordered) ORDER BY ordered, id) AS best FROM c)"""


def closings(spark, sf_dir):
    """Orders with the date on which they close (the last shipment of a finished one), and on which order of the customer's year each depends: the one before it."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    orders = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    nodes = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("last")).alias("closes"))
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    depends = orders.select(F.lag("o_orderkey").over(w).alias("src"), F.col("o_orderkey").alias("dst")).filter("src is not null")
    return nodes, depends


@query("cascade_closings", [317], f"""WITH {CLOSING_SQL}, r AS (SELECT id, own AS closes, id AS cause, 1 AS known_from, own IS DISTINCT FROM best.closes AS superseded FROM w
 UNION ALL SELECT id, best.closes, best.cause, 2, false FROM w WHERE own IS DISTINCT FROM best.closes)
SELECT id, coalesce(strftime(closes, '%Y-%m-%d'), 'open') AS closes, cause::BIGINT AS cause, known_from, superseded FROM r""")
def cascade_closings(spark, sf_dir):
    """A closing closes all that depends on it, however far: what was known of each order's closing before and after, and whose closing moved it."""
    nodes, depends = closings(spark, sf_dir)
    after = X.cascade(nodes, depends)
    rows = X.bitemporal(nodes, after, ["id"], "closes", F.lit(1), F.lit(2))
    causes = after.select("id", "cause")
    day = F.coalesce(F.date_format("closes", "yyyy-MM-dd"), F.lit("open")).alias("closes")
    return rows.join(causes, "id").select("id", day, F.when(F.col("known_from") == 2, F.col("cause")).otherwise(F.col("id")).alias("cause"), "known_from", F.col("known_until").isNotNull().alias("superseded"))
