"""Hard-negative mining with Kronecker-packed products.

The candidates of a list are packed by component: the d-th components of all
of them, biased so that none is below zero, lie side by side in the fields of
one wide integer. An anchor multiplies each of these integers once by its own
component; the sum of the products has every candidate's inner product in its
field. What negative components of the anchor could take from a field is added
to all fields before, so that no field borrows from the next; fields are as
wide as the largest sum needs. Taking biases off gives exact scores.

Positives come from a first pass over all rows, negatives from a second one
that looks, for each anchor and positive, for scores in the range that the
positive's score allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .maxscore import best
from .vector_blocks import NONE, Block, blocks, fits, integer_vectors, lists, meet, same_width, some_of


class Packed:
    """The components of candidates, packed into one wide integer for each component."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n = len(rows)
        self.bias = -int(rows.min(initial=0))
        self.fields = rows + self.bias
        self.most = int(self.fields.max(initial=0))
        self.wide: dict[int, list[int]] = {}

    def components(self, size: int) -> list[int]:
        if size not in self.wide:
            self.wide[size] = [int.from_bytes(np.ascontiguousarray(column, f"<u{size}").tobytes(), "little") for column in [*self.fields.T, np.ones(self.n, np.int64)]]
        return self.wide[size]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner product of the anchor with every candidate."""
        spare = sum(-a for a in anchor if a < 0) * self.most
        largest = spare + sum(a for a in anchor if a > 0) * self.most
        size = 4 if largest < 1 << 32 else 8
        *parts, ones = self.components(size)
        total = spare * ones
        for a, wide in zip(anchor, parts):
            if a:
                total += a * wide
        fields = np.frombuffer(total.to_bytes(size * self.n, "little"), f"<u{size}").astype(np.int64)
        return fields - (spare + self.bias * sum(anchor))


def _packed(rows: Block, theirs: np.ndarray) -> Packed:
    if getattr(rows, "packed", None) is None or rows.packed.fields.shape[1] != theirs.shape[1]:
        rows.packed = Packed(theirs)
    return rows.packed


class Positives:
    """Notes of rows: label; of anchors: label, least score. The best others of the anchor's label."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in block.ids]
        self.least = block.notes[:, 1].tolist()

    def add(self, rows: Block) -> None:
        mine, theirs = same_width(self.block.vectors, rows.vectors)
        fits(mine, theirs)
        wide = _packed(rows, theirs)
        for i, (own, anchor, label) in enumerate(zip(self.block.ids, mine.tolist(), self.block.notes[:, 0])):
            scores = wide.scores(anchor)
            at = np.flatnonzero((rows.notes[:, 0] == label) & (scores >= self.least[i]) & (rows.ids != own))
            if not at.size:
                continue
            ids, got = np.concatenate([self.found[i][0], rows.ids[at]]), np.concatenate([self.found[i][1], scores[at]])
            first = best(got, ids, self.k)
            self.found[i] = ids[first], got[first]
            if first.size == self.k:
                self.least[i] = max(self.least[i], int(got[first[-1]]))

    def rows(self) -> pa.RecordBatch:
        sizes = [ids.size for ids, _ in self.found]
        columns = [np.repeat(self.block.ids, sizes), *(np.concatenate([f[i] for f in self.found] or [np.empty(0, np.int64)]) for i in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score"])


class Negatives:
    """Notes of anchors: label, then lowest and highest score for each positive. The best of other labels in each range."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.ranges = [[(int(a), int(b)) for a, b in zip(row[1::2], row[2::2]) if b != NONE] for row in block.notes]
        self.found = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * len(r) for r in self.ranges]

    def add(self, rows: Block) -> None:
        mine, theirs = same_width(self.block.vectors, rows.vectors)
        fits(mine, theirs)
        wide = _packed(rows, theirs)
        for i, (own, anchor, label, ranges) in enumerate(zip(self.block.ids, mine.tolist(), self.block.notes[:, 0], self.ranges)):
            if not ranges:
                continue
            scores = wide.scores(anchor)
            some = np.flatnonzero((rows.notes[:, 0] != label) & (rows.ids != own) & (scores >= min(a for a, _ in ranges)) & (scores <= max(b for _, b in ranges)))
            ids, got = rows.ids[some], scores[some]
            for j, (low, high) in enumerate(ranges):
                at = np.flatnonzero((got >= low) & (got <= high))
                if not at.size:
                    continue
                both, score = np.concatenate([self.found[i][j][0], ids[at]]), np.concatenate([self.found[i][j][1], got[at]])
                first = best(score, both, self.k)
                self.found[i][j] = both[first], score[first]
                if first.size == self.k:
                    ranges[j] = max(low, int(score[first[-1]])), high

    def rows(self) -> pa.RecordBatch:
        every = [(own, j, *f) for own, found in zip(self.block.ids, self.found) for j, f in enumerate(found)]
        sizes = [len(ids) for _, _, ids, _ in every]
        columns = [np.repeat(np.array([e[i] for e in every], np.int64), sizes) for i in (0, 1)]
        columns += [np.concatenate([e[i] for e in every] or [np.empty(0, np.int64)]) for i in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "place", "negative_id", "negative_score"])


POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, place long, negative_id long, negative_score long"


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, label: str = "label", positives: int = 5, negatives: int = 10, scale: int = 256,
    lowest: int = 30, highest: int = 90, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: rows like those of vectors. An anchor's positives are the other
    rows of its label with the highest scores; for each, the first of the rows
    of other labels whose score is between ``lowest`` and ``highest`` hundredths
    of the positive's. Scores are integer inner products of floor(scale * x);
    higher come first, ties by smaller id. A positive whose score is below zero
    has no negatives, since no number lies in that range.

    Rows with a null id, a null label, a null vector, or a null or non-finite
    component take no part; shorter vectors count as ending in zeros. Rows that
    repeat an id are candidates one by one, none of them for an anchor of that
    id; an anchor id that several rows have asks once, with the smallest vector
    (of equal ones the smallest label). No rows or no anchors give no rows.
    Scores that don't fit into 64 bits raise ArithmeticError.
    """
    own = F.col(label).cast("long")
    rows = lists(integer_vectors(vectors.filter(own.isNotNull()), scale, id_col, vector_col, F.array(own)))
    asking = integer_vectors(anchors.filter(own.isNotNull()), scale, id_col, vector_col, F.array(own))
    asking = materialize(asking.groupBy("id").agg(F.min(F.struct("v", "notes")).alias("own")).select("id", "own.v", "own.notes"), "anchors")

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    placed = lambda found: found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = blocks(asking.withColumn("notes", F.concat("notes", F.array(F.lit(NONE)))))
    some = placed(meet(some_of(rows), near, lambda b: Positives(b, positives), POSITIVES, "some-positives"))
    least = some.filter(F.col("place") == positives).select(F.col("anchor_id").alias("id"), F.col("positive_score").alias("least"))
    near = blocks(asking.join(least, "id", "left").select("id", "v", F.concat("notes", F.array(F.coalesce("least", F.lit(NONE)))).alias("notes")))
    paired = materialize(placed(meet(rows, near, lambda b: Positives(b, positives), POSITIVES, "all-positives")).withColumn("place", F.col("place").cast("long") - 1), "positives")

    # The range of scores that each positive allows: lowest * p <= 100 * n <= highest * p.
    p = F.col("positive_score")
    low, high = F.expr(f"{lowest} * positive_score div 100"), F.expr(f"{highest} * positive_score div 100")
    low = F.when(low * 100 < lowest * p, low + 1).otherwise(low)
    ranges = paired.withColumn("low", F.when(p < 0, 1).otherwise(low)).withColumn("high", F.when(p < 0, 0).otherwise(high))

    turn = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= negatives)

    def noted(ranges: DataFrame) -> DataFrame:
        places = ranges.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("of"))
        flat = F.flatten(F.transform("of", lambda x: F.array(x["low"], x["high"])))
        return blocks(asking.join(places, "id").select("id", "v", F.concat("notes", flat).alias("notes")))

    start = lambda b: Negatives(b, negatives)
    some = ranked(meet(some_of(rows), noted(ranges), start, NEGATIVES, "some-negatives"))
    least = some.filter(F.col("rank") == negatives).select("anchor_id", "place", F.col("negative_score").alias("least"))
    nearer = ranges.join(least, ["anchor_id", "place"], "left").withColumn("low", F.greatest("low", "least"))
    found = ranked(meet(rows, noted(nearer), start, NEGATIVES, "all-negatives"))
    both = found.join(paired, ["anchor_id", "place"])
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))
