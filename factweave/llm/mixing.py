"""Mixing sources to target weights: weighted sampling without replacement by exponential keys.

A document's key is -ln(u) / w, with u from a hash of its id and w its quality
weight; the order of the keys is a weighted random order (Efraimidis and
Spirakis). Each source has a token budget. Complete epochs take every document
of the source; the rest of the budget takes the documents with the smallest
keys, up to a prefix sum of their sizes.

The prefix is found in two levels, so that a source with a third of all rows is
never sorted in one task: sizes are summed in key ranges (an aggregation with a
map side), the prefix sums of the ranges show which one range of each source
the budget ends in, and only the rows of that range are sorted. A range is
1/``ranges`` of a source. Rows that repeat an id have one key; they are counted
before the range is sorted, and dealt out again by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, quoted, table, with_row_key

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts, the same in every run."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def es_key(u: Column, weight: Column) -> Column:
    return -F.log(u) / weight


def key_range(key: Column, ranges: int) -> Column:
    """The key's range: rises with the key, and keys of weight about 1 fill the ranges evenly."""
    return F.floor((1 - F.exp(-key)) * ranges).cast("long")


def source_order(source: Column) -> list[Column]:
    """By code point, null last."""
    return [source.isNull(), source]


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes has source and source_size, one row per source; adds target.

    All targets together are ``share`` of all sizes. They go by weight, but no
    target exceeds ``cap`` times its source's size; what is above goes to the
    others by weight until none is above. That ends with min(cap * size, level *
    weight), where one level holds for all sources. Capped are the sources with
    the smallest cap * size / weight, so the level follows from prefix sums in
    that order. The windows run over the catalogue of sources, one row each.
    """
    by_name = Window.orderBy(*source_order(F.col("source")))
    by_ratio = Window.orderBy("ratio", *source_order(F.col("source")))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    levels = (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * float(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("capped_size", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("level", (F.col("total") - F.col("capped_size")) / F.col("left_weight"))
        .withColumn("found", F.max(F.when(F.col("level") <= F.col("ratio"), F.struct(-F.col("ratio"), F.col("level")))).over(everything))
    )
    own = F.coalesce(F.col("found.level") * F.col("weight"), F.col("most"))
    return levels.select("source", "source_size", F.least("most", own).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    ranges: int = 4096,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, quality_weight, key.

    size is the number of words; sources by code point, null last, have
    ``weights``, repeating. taken is size times the epochs that the document is
    in: all complete epochs, and one more if it belongs to the fraction. The
    document in which the budget ends belongs to it if that brings the source
    nearer to its target.

    quality: doc_id and quality_weight (above 0); documents without one have 1.
    Rows that repeat an id have the same key and follow one another. Null texts
    and texts without words have size 0 and nothing is taken from them; a null
    source is a source of its own; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    if quality is None:
        rows = rows.withColumn("quality_weight", F.lit(1.0))
    else:
        own = quality.groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality_weight").alias("w")).filter("w > 0")
        rows = rows.join(own, rows["doc_id"] == own["_id"], "left").select(
            "doc_id", "source", "size", F.coalesce("w", F.lit(1.0)).alias("quality_weight")
        )
    key = es_key(uniform(F.lit(seed), F.col("doc_id")), F.col("quality_weight"))
    rows = materialize(rows.withColumn("key", key).withColumn("range", key_range(F.col("key"), ranges)), "mix-sizes")

    sums = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    goals = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    goals = goals.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("before_range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .withColumnRenamed("source", "_s")
        .join(goals, F.col("_s").eqNullSafe(F.col("source")))
        .filter("before_range < rest and rest <= before_range + range_size")
        .select(F.col("_s").alias("s"), F.col("range").alias("end_range"), "before_range")
    )
    goals = goals.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    goals = materialize(goals.withColumnRenamed("source", "_source"), "mix-targets")

    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    inside = rows.filter(F.col("end_range").isNull() | (F.col("range") != F.col("end_range"))).withColumn(
        "more", (F.col("range") < F.col("end_range")) & F.col("end_range").isNotNull()
    )
    edge = edge_rows(rows.filter(F.col("range") == F.col("end_range")))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("more"), 1).otherwise(0))
    return inside.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "quality_weight", "key"
    )


#: Equal rows that one task writes.
AT_ONCE = 1 << 16


def edge_rows(rows: DataFrame) -> DataFrame:
    """The rows of the ranges in which budgets end, with ``more``: whether the prefix takes the row.

    Equal rows are counted with a map side; the window sees each once.
    """
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    own = equal.withColumn("before", F.col("before_range") + F.sum(F.col("n") * F.col("size")).over(upto) - F.col("n") * F.col("size"))
    one = (F.col("before") + F.col("size") - F.col("size") / 2 <= F.col("rest")).cast("long")
    some = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)))
    own = own.withColumn("times", F.when(F.col("n") == 1, one).when(F.col("size") > 0, some).otherwise(F.lit(0)))
    single = own.filter("n = 1").withColumn("more", F.col("times") > 0)
    parts = own.filter("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / AT_ONCE))))
    dealt = parts.repartition("source", "doc_id", "part")
    first = F.col("part") * AT_ONCE + 1
    place = F.explode(F.sequence(first, F.least(first + AT_ONCE - 1, F.col("n"))))
    several = dealt.withColumn("place", place).withColumn("more", F.col("place") <= F.col("times"))
    return single.select(*rows.columns, "more").unionByName(several.select(*rows.columns, "more"))


def label_quality(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for documents labelled good, 0.5 for those labelled bad."""
    rated = labels.filter("doc_id is not null and quality is not null")
    return rated.select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("quality_weight"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    quality = label_quality(table(spark, sf_dir, "labels"))
    mix = mix_sources(table(spark, sf_dir, "documents"), quality=quality)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0, 1 or 2.

    Documents without words are in no mix. Rows that repeat an id, null among
    them, count one by one, each with the quality of its id.
    """
    rows, row = with_row_key(docs, "doc_id")
    quality = label_quality(table(spark, sf_dir, "labels"))
    rated = rows.select(F.col("doc_id"), quoted(row).alias("key")).join(quality, "doc_id").select(F.col("key").alias("doc_id"), "quality_weight")
    mix = mix_sources(rows, id_col=row, quality=rated).filter("taken > 0")
    which, times = fresh("_which", rows.columns), fresh("_times", rows.columns)
    found = mix.select(F.col("doc_id").alias(which), F.expr("int(taken / size)").alias(times))
    joined = rows.join(found, rows[row].eqNullSafe(found[which]))
    kept = [quoted(c) for c in docs.columns]
    return joined.select(*kept, F.explode(F.sequence(F.lit(1), F.col(times))).alias(which)).select(*kept)


ORACLE_SQL = """
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('0|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u,
         coalesce(q.w, 1.0::DOUBLE) AS w
  FROM documents d LEFT JOIN (
    SELECT doc_id, avg(CASE WHEN quality > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w
    FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q USING (doc_id)),
keyed AS (SELECT *, -ln(u) / w AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS most
  FROM sources),
levels AS (
  SELECT *, most / weight AS ratio,
         ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE
           - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / ((SELECT sum(weight) FROM weighed)
           - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         least(most, coalesce((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1) * weight, most)) AS target
  FROM levels),
placed AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size
                               AND target > epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
