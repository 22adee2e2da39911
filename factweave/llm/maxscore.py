"""Exact top-k search by MaxScore.

A vector is a document whose terms are its components' signs: component d
above zero is term (d, +), below zero term (d, -), and its size is the term's
impact. A query's component is a weight on the term of its own sign; the term
of the other sign takes away. Within a shard (a list of rows) each term has a
posting list and a bound, weight times the largest impact. With the terms
ordered by their bounds, those whose bounds together don't reach the score
that a query's k-th result has so far are not essential: a row in none of the
essential postings can't get into the result. Essential postings are
traversed; rows that were met are probed for the other terms, the largest
bounds first, as long as what they have and what is left could compete.
Shards' results are merged: in the task, then by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .vector_blocks import NONE, Block, blocks, fits, integer_vectors, lists, meet, same_width, some_of

#: Components that are probed between two looks at which rows still compete.
PROBED = 8


class Shard:
    """The postings of a list of rows: for each component and sign the rows that have it and their impacts."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.most = np.zeros((2, rows.shape[1]), np.int64)
        for d in range(rows.shape[1]):
            for sign in (1, -1):
                impacts = rows[:, d] * sign
                at = np.flatnonzero(impacts > 0)
                self.postings[d, sign] = at, impacts[at]
                self.most[int(sign < 0), d] = impacts.max(initial=0)

    def search(self, query: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows whose score is ``least`` at least, with their scores; of all rows if there is no least."""
        sign, weight = np.sign(query), np.abs(query)
        bound = weight * self.most[(sign < 0).astype(int), np.arange(query.size)]
        order = np.argsort(bound, kind="stable")
        reach = np.cumsum(bound[order])
        rest = 0 if least is None else int(np.searchsorted(reach, least))
        others, essential = order[:rest][::-1], order[rest:]
        left = int(reach[rest - 1]) if rest else 0

        scores = np.zeros(len(self.rows), np.int64)
        for d in essential[::-1]:
            if query[d]:
                at, impacts = self.postings[d, int(sign[d])]
                scores[at] += weight[d] * impacts
        if least is None or left >= least:  # rows outside of the essential postings compete as well
            met = np.arange(len(self.rows))
        else:
            met = np.flatnonzero((scores > 0) & (scores + left >= least))
        got = scores[met]

        def competing():
            nonlocal met, got
            if least is not None:
                stay = got + left >= least
                met, got = met[stay], got[stay]

        for i in range(0, essential.size, PROBED):  # what the same components take away
            dims = essential[::-1][i : i + PROBED]
            got = got + np.minimum(self.rows[met[:, None], dims[None, :]] * sign[dims], 0) @ weight[dims]
            competing()
        for i in range(0, others.size, PROBED):
            dims = others[i : i + PROBED]
            got = got + self.rows[met[:, None], dims[None, :]] @ query[dims]
            left -= int(bound[dims].sum())
            competing()
        return met, got


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in order."""
    if scores.size > 4 * k:
        cut = np.partition(scores, scores.size - k)[scores.size - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class TopK:
    """The k best rows for each query of a block, over the lists that a task has met."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in block.ids]
        self.least = [int(x) if x != NONE else None for x in block.notes[:, 0]]

    def add(self, rows: Block) -> None:
        mine, theirs = same_width(self.block.vectors, rows.vectors)
        fits(mine, theirs)
        if getattr(rows, "shard", None) is None or rows.shard.rows.shape[1] != theirs.shape[1]:
            rows.shard = Shard(theirs)
        for i, own in enumerate(self.block.ids):
            met, got = rows.shard.search(mine[i], self.least[i])
            other = rows.ids[met] != own
            ids, scores = np.concatenate([self.found[i][0], rows.ids[met][other]]), np.concatenate([self.found[i][1], got[other]])
            first = best(scores, ids, self.k)
            self.found[i] = ids[first], scores[first]
            if first.size == self.k:
                self.least[i] = max(int(scores[first[-1]]), NONE if self.least[i] is None else self.least[i])

    def rows(self) -> pa.RecordBatch:
        sizes = [ids.size for ids, _ in self.found]
        columns = [np.repeat(self.block.ids, sizes), *(np.concatenate([f[i] for f in self.found] or [np.empty(0, np.int64)]) for i in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows with the highest integer inner products, ties to smaller ids.

    queries: rows like those of vectors. A query's own id is no candidate.
    Components x count as floor(scale * x). Rows with a null id, a null vector,
    or a null or non-finite component take no part; shorter vectors count as
    ending in zeros. Rows that repeat an id are candidates one by one; a query
    id that several rows have asks once, with the smallest vector. No rows or
    no queries give no rows. Scores that don't fit into 64 bits raise
    ArithmeticError.
    """
    shards = lists(integer_vectors(vectors, scale, id_col, vector_col, F.array().cast("array<long>")))
    whole = integer_vectors(queries, scale, id_col, vector_col, F.array(F.lit(NONE)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = meet(some_of(shards), blocks(whole), lambda b: TopK(b, k), FOUND, "first-found")
    least = ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    asked = whole.join(least, "id", "left").select("id", "v", F.array(F.coalesce("least", F.lit(NONE))).alias("notes"))
    found = meet(shards, blocks(asked), lambda b: TopK(b, k), FOUND, "found")
    return ranked(found).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true))
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id)::INT AS rank, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""


def op12_maxscore(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))
