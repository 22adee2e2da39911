"""Validity, as-of, version and recency operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def valid_at(df: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_until", end_inclusive: bool = False) -> DataFrame:
    """Rows whose validity holds at a time: from the start on, up to the end; a null bound is open."""
    before_end = F.col(end) >= at if end_inclusive else F.col(end) > at
    return df.filter((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | before_end))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, right_id: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time.

    One shuffle by key over the union of both sides; the latest right row is
    carried forward by a window. Rows of right at the same time: the largest id
    counts. Left rows without a match keep nulls.
    """
    carried = F.struct(*[F.col(v).alias(f"asof_{v}") for v in values])
    one = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_id"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_right"))
    two = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(right_id).cast("long").alias("_id"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), carried.alias("_right"))
    upto = Window.partitionBy(*keys).orderBy("_t", "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("_asof", F.last("_right", ignorenulls=True).over(upto))
    return both.filter("_side = 1").select("_left.*", "_asof.*")


def latest_before(df: DataFrame, keys: Sequence[str], time: str, tie: str, at: Column) -> DataFrame:
    """For each key the newest row at or before a time, with the ids before and after it."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    ranked = df.withColumn("predecessor", F.lag(tie).over(order)).withColumn("successor", F.lead(tie).over(order))
    best = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return ranked.filter(F.col(time) <= at).withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def with_obsolescence(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """obsolete: a row of the same key is newer."""
    return df.withColumn("obsolete", F.col(time) < F.max(time).over(Window.partitionBy(*keys)))


def without_successor(df: DataFrame, edges: DataFrame, id_col: str, at: Column) -> DataFrame:
    """Drops rows that an edge (old_id, from, until) replaces at a time."""
    active = edges.filter((F.col("from") <= at) & (F.col("until").isNull() | (F.col("until") > at)))
    return df.join(active.select(F.col("old_id").alias(id_col)), id_col, "left_anti")


def recency_weight(date: Column, reference: Column, decay_years: float) -> Column:
    """exp(-0.693 * whole years / decay); 1 for null dates and for the future."""
    years = F.floor(F.months_between(reference, date) / 12)
    return F.when(date.isNull() | (date > reference), 1.0).otherwise(F.exp(-0.693 * years / decay_years))


def period_changes(df: DataFrame, start: Column, end: Column, id_col: str, replaced: DataFrame) -> DataFrame:
    """introduced, retired and modified rows of a period; a row can be in several.

    replaced: ids that an edge replaces, with the edge's time as ``at``.
    """
    within = lambda c: (c >= start) & (c < end)
    new = df.filter(within(F.col("valid_from"))).select(id_col, F.lit("introduced").alias("change"))
    old = df.filter(within(F.col("valid_until"))).select(id_col, F.lit("retired").alias("change"))
    moved = replaced.filter(within(F.col("at"))).select(id_col, F.lit("modified").alias("change"))
    return new.unionByName(old).unionByName(moved)


def cascade(nodes: DataFrame, depends: DataFrame, rounds: int = 200) -> DataFrame:
    """id, closes, cause, moved_in: when each node closes, if it closes no later than anything that it depends on.

    nodes: id, closes (null: open); depends: src, dst (dst depends on src). Only
    what moved in a round is looked at in the next, until nothing moves, so a
    cycle ends as well. cause: whose own closing it is, of equal times the
    smallest id; moved_in: the round in which the node moved last, 0 if never.
    Nodes that only ``depends`` has are left out; repeated ids count once, with
    the earliest closing.
    """
    own = nodes.groupBy("id").agg(F.min("closes").alias("closes"))
    state = written(own.select("id", F.when(F.col("closes").isNotNull(), F.struct("closes", F.col("id").alias("cause"))).alias("at"), F.lit(0).cast("long").alias("moved_in")))
    edges = written(depends.filter("src != dst").select("src", "dst").distinct())
    delta = state.filter("at is not null").select("id", "at")
    for turn in range(1, rounds + 1):
        reached = edges.join(delta, edges["src"] == delta["id"]).groupBy(F.col("dst").alias("_n")).agg(F.min("at").alias("new"))
        moved = written(state.join(reached, state["id"] == reached["_n"]).filter(F.col("at").isNull() | (F.col("new") < F.col("at"))).select("id", F.col("new").alias("at")))
        if moved.isEmpty():
            return state.select("id", "at.closes", "at.cause", "moved_in")
        newer = moved.select(F.col("id").alias("_m"), F.col("at").alias("_at"))
        state = written(state.join(newer, state["id"] == newer["_m"], "left").select("id", F.coalesce("_at", "at").alias("at"), F.when(F.col("_at").isNotNull(), turn).otherwise(F.col("moved_in")).cast("long").alias("moved_in")))
        delta = moved
    raise RuntimeError(f"closings still move after {rounds} rounds")


def bitemporal(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, known_from: Column, changed_at: Column) -> DataFrame:
    """keys, value, known_from, known_until: what was known of each key and when; a changed value closes its old row and opens a new one."""
    old = before.select(*keys, F.col(value).alias("_old"))
    both = old.join(after.select(*keys, F.col(value).alias("_new")), list(keys), "left")
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    kept = both.select(*keys, F.col("_old").alias(value), known_from.alias("known_from"), F.when(changed, changed_at).alias("known_until"))
    opened = both.filter(changed).select(*keys, F.col("_new").alias(value), changed_at.alias("known_from"), F.lit(None).cast(before.select(changed_at).schema[0].dataType).alias("known_until"))
    return kept.unionByName(opened)


#: Levels of the time tree: 2^LEVELS units of time.
LEVELS = 40


def tree_nodes(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The nodes (level, place) of a binary tree over whole times that make up [start, end) together: two for each level at most."""

    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        s, e = F.floor((start + width - 1) / width), F.floor(end / width)
        left = F.when((s < e) & (s % 2 != 0), s)
        right = F.when((s < e) & (e % 2 != 0), e - 1)
        return F.transform(F.filter(F.array(left, right), lambda p: p.isNotNull()), lambda p: F.struct(level.alias("level"), p.cast("long").alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def node_of(time: Column, level: Column) -> Column:
    return F.floor(time / F.call_function("shiftleft", F.lit(1).cast("long"), level)).cast("long")


#: Right rows of a key up to which its rows meet one another by the key alone; those of more frequent keys meet by the tree.
FEW = 256


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, levels: int = LEVELS, few: int = FEW) -> DataFrame:
    """Pairs of a left and a right row of equal keys whose validities [start, end) share a moment, each pair once; left and right as structs.

    start, end: whole numbers not below zero and under 2^levels; a null start
    is the beginning, a null end is open. Of two that overlap, one begins while
    the other holds: an equi-join of a moment's tree nodes with an interval's,
    of which exactly one meets. An interval is a few dozen rows however long it
    is; no rows are paired but those of the result. So many rows only pay where
    a key is frequent: keys with up to ``few`` right rows meet by an equi-join
    on the key, which compares a left row with ``few`` others at most. Empty
    validities meet nothing; rows with a null key neither.
    """
    most = 1 << levels
    begin, until = F.coalesce(F.col(start), F.lit(0)).cast("long"), F.coalesce(F.col(end), F.lit(most)).cast("long")
    shape = lambda df, side: df.filter(begin < until).select(*keys, begin.alias("_s"), until.alias("_e"), F.struct(*df.columns).alias(side))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    points = lambda df: df.select("*", level).withColumn("place", node_of(F.col("_s"), F.col("level"))).drop("_s", "_e")
    spans = lambda df: df.select("*", F.explode(tree_nodes(F.col("_s"), F.col("_e"), levels)).alias("_n")).select("*", "_n.level", "_n.place").drop("_n", "_e")
    a, b = shape(left, "left"), shape(right, "right")
    many = written(right.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > few).select(*keys))
    rare, by_key = a.join(many, keys, "left_anti"), b.withColumnsRenamed({"_s": "_s2", "_e": "_e2"})
    direct = rare.join(by_key, list(keys)).filter("_s < _e2 and _s2 < _e").select("left", "right")
    if many.isEmpty():
        return direct
    a, b = a.join(many, keys, "left_semi"), b.join(many, keys, "left_semi")
    on = [*keys, "level", "place"]
    # Levels that no interval of the other side uses meet nothing; they are left out before the points are dealt.
    used = lambda df: df.select("level").distinct()
    sa, sb = spans(a), spans(b)
    later = points(b).join(used(sa), "level", "left_semi").join(sa.drop("_s"), on).select("left", "right")
    earlier = points(a).join(used(sb), "level", "left_semi").join(sb, on)
    # Equal beginnings are found both ways: they count where the right row begins within the left one.
    earlier = earlier.filter(F.coalesce(F.col(f"left.{start}"), F.lit(0)).cast("long") > F.col("_s")).select("left", "right")
    return direct.unionByName(later).unionByName(earlier)
