"""An inverted-file index over vectors: cells around centroids, a few of which a query visits.

The centroids are fitted on a bounded sample; every row is then assigned to its
nearest one. A query visits the cells whose centroids are nearest to it, so a
row meets the queries of its own cell: an equi-join on the cell, of lists of
rows with blocks of queries, each pair one matrix product. What a query costs is
its visits times the rows of a cell, not the whole table. How many cells are
visited is found on a bounded set of queries, for which exact neighbours are
worked out: the fewest that reach the recall that was asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import blocks
from .blocks import comparable, of_width, unit
from .graph import cut

#: Most rows on which centroids are fitted, and queries on which visits are chosen.
FITTED = 65_536
TRIED = 256
#: Most cells; with 64 components their centroids take 4 MB.
CELLS = 8192
ROWS_AT_ONCE = 2048
QUERIES_AT_ONCE = 1024


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled with zeros, longer ones cut to what the centroids have."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    at, end = 0, min(width, int(lengths.max(initial=0)))
    for i, n in enumerate(lengths.tolist()):
        out[i, : min(n, end)] = values[at : at + min(n, end)]
        at += n
    return out


@dataclass
class Index:
    """rows: id, v, tag, cell; centroids: a matrix of at most CELLS rows; sizes: how many rows each cell has."""

    rows: DataFrame
    centroids: np.ndarray
    visits: int = 0
    recall: float = 0.0


def fit_centroids(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centroids by k-means on at most FITTED rows, those whose ids hash lowest, in one partition, so that reruns agree."""
    share = min(1.0, 2.0 * FITTED / max(vectors.count(), 1))
    some = vectors.withColumn("h", F.xxhash64("id")).filter(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000))
    some = some.orderBy("h", "id").limit(FITTED)  # a top-k: tasks pass on no more than this
    rows = cut(some.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features")).coalesce(1))
    n = rows.count()
    if not n:
        return np.zeros((1, 1))
    if n <= max(cells, 2):  # each row is its own centroid
        return unit(np.array([r["features"].toArray() for r in rows.collect()]))
    found = KMeans(k=max(cells, 2), seed=42, maxIter=8, initMode="random").fit(rows).clusterCenters()
    return unit(np.array(found))


def _cells_of(centroids: np.ndarray, n: int):
    """Adds the n nearest centroids of each row of (id, v, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                near = unit(matrix(part.column("v"), centroids.shape[1])) @ centroids.T
                some = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
                order = np.take_along_axis(some, np.lexsort((some, -np.take_along_axis(near, some, 1)), axis=1), 1)
                cells = pa.ListArray.from_arrays(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32), pa.array(order.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, "cells"])

    return run


def with_cells(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """rows (id, v, tag) with the list of their n nearest cells."""
    ship_package(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_cells_of(centroids, n), f"id {kind}, v array<double>, tag string, cells array<int>")


def plain_rows(vectors: DataFrame, id_col: str, vector_col: str, tag: str | None) -> DataFrame:
    """id, v, tag of the rows with an id and a vector whose components are all finite numbers; others can't be compared."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    own = vectors.select(F.col(id_col).alias("id"), v.alias("v"), (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"))
    return own.filter(F.col("id").isNotNull() & comparable("v"))


def build(vectors: DataFrame, id_col: str, vector_col: str, tag: str | None = None, cells: int | None = None) -> Index:
    """The index over all rows that can be compared; by default as many cells as the square root of the rows, CELLS at most."""
    rows = cut(plain_rows(vectors, id_col, vector_col, tag))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = rows.withColumn("v", of_width(F.col("v"), width))  # shorter vectors count as ending in zeros
    if cells is None:
        cells = int(min(CELLS, max(2, round(rows.count() ** 0.5))))
    centroids = fit_centroids(rows, cells)
    own = with_cells(rows, centroids, 1).select("id", "v", "tag", F.element_at("cells", 1).alias("cell"))
    return Index(cut(own), centroids)


def _best(k: int, rule: str, least: float | None):
    """For pairs of a list of rows and a block of queries: each query's k best rows by rounded cosine, then by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asked = (batch.column(c)[i].values for c in ("ids", "asked"))
                width = batch.column("width")[i].as_py()
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("q", "r"))
                similar = np.round(unit(a) @ unit(b).T, 6) + 0.0
                row_ids, own = ids.to_numpy(zero_copy_only=False), asked.to_numpy(zero_copy_only=False)
                out = own[:, None] == row_ids[None, :]
                if rule:
                    x, y = (np.array([str(t) for t in batch.column(c)[i].values.to_pylist()]) for c in ("asked_tags", "tags"))
                    same = x[:, None] == y[None, :]
                    out |= ~same if rule == "within" else same
                if least is not None:
                    out |= similar < least
                similar = np.where(out, -np.inf, similar)
                if similar.shape[1] > k:  # all that equal the k-th best stay, ties are for the ids to break
                    bar = -np.partition(-similar, k - 1, axis=1)[:, k - 1]
                    out |= similar < bar[:, None]
                which, chosen = np.nonzero(~out)
                order = np.lexsort((row_ids[chosen], -similar[which, chosen], which))
                which, chosen = which[order], chosen[order]
                place = np.arange(which.size) - np.searchsorted(which, which)
                which, chosen = which[place < k], chosen[place < k]
                columns = [asked.take(pa.array(which)), ids.take(pa.array(chosen)), pa.array(similar[which, chosen])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "similarity"])

    return run


def packed(rows: DataFrame, size: int, width: int) -> DataFrame:
    """cell, ids, tags, flat: the rows of each cell in lists of about ``size``, the vectors one after another with ``width`` components each."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)).alias("part")
    lists = rows.join(sizes, "cell").select("cell", part, F.struct("id", F.coalesce("tag", F.lit("")).alias("tag"), of_width(F.col("v"), width).alias("v")).alias("x"))
    lists = lists.groupBy("cell", "part").agg(F.collect_list("x").alias("x"))
    return lists.select("cell", "part", F.col("x.id").alias("ids"), F.col("x.tag").alias("tags"), F.flatten("x.v").alias("flat"))


def search(index: Index, queries: DataFrame, k: int, visits: int | None, rule: str = "", least: float | None = None) -> DataFrame:
    """query_id, id, similarity, rank: for each query (id, v, tag) the k best rows of the ``visits`` cells nearest to it.

    rule: "across" takes only rows of another tag, "within" only rows of the
    same; least: no row below this similarity. A query's own id is left out;
    equal similarities go by id. Null tags are one tag. Without ``visits`` a
    query visits every cell that could have a row of similarity ``least``
    (above zero), so the result is exact.
    """
    spark = queries.sparkSession
    width = index.centroids.shape[1]
    if visits is None and (least is None or least <= 0):
        raise ValueError("without visits least must be above zero")
    if visits is None:
        ship_package(spark)
        own = queries.schema["id"].dataType.simpleString()
        asked = queries.select("id", "v", "tag").mapInArrow(_cells_within(index.centroids, reach_of(index), least), f"id {own}, v array<double>, tag string, cells array<int>")
    else:
        asked = with_cells(queries, index.centroids, min(visits, len(index.centroids)))
    asked = asked.select("id", "v", "tag", F.explode("cells").alias("cell"))
    blocks = packed(cut(asked), QUERIES_AT_ONCE, width).select("cell", F.col("ids").alias("asked"), F.col("tags").alias("asked_tags"), F.col("flat").alias("q"))
    lists = packed(index.rows, ROWS_AT_ONCE, width).select("cell", "part", "ids", "tags", F.col("flat").alias("r"))
    # Lists of a large cell are spread by their part; blocks of queries follow by the join.
    met = lists.join(blocks, "cell").select("ids", "tags", "r", "asked", "asked_tags", "q", F.lit(width).alias("width"))
    kind, asking = index.rows.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")  # a row is a list and a block; read when the plan runs, which it does here
    try:
        found = cut(met.mapInArrow(_best(k, rule, least), f"query_id {asking}, id {kind}, similarity double"))
    finally:
        spark.conf.set(key, before)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def choose_visits(index: Index, queries: DataFrame, k: int, recall: float, rule: str = "", least: float | None = None) -> Index:
    """The index with the fewest visits (doubling from one) that find ``recall`` of the exact neighbours of at most TRIED of the queries.

    Visits are raised on the tried queries until their recall is reached; all
    cells give all neighbours, so it always is.
    """
    few = cut(queries.orderBy(F.xxhash64("id"), "id").limit(TRIED))
    every = len(index.centroids)
    exact = cut(search(index, few, k, every, rule, least).select("query_id", "id"))
    wanted = exact.count()
    visits = max(1, every // 16)
    while visits < every and wanted:
        found = search(index, few, k, visits, rule, least).join(exact, ["query_id", "id"], "left_semi").count()
        if found >= recall * wanted:
            return Index(index.rows, index.centroids, visits, found / wanted)
        visits = min(every, visits * 2)
    return Index(index.rows, index.centroids, every, 1.0)


def _cells_within(centroids: np.ndarray, reach: np.ndarray, least: float):
    """Adds the cells of which some row may have a similarity of ``least`` with the row. reach: the largest angle of a cell's rows with its centroid, below zero if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                m = unit(matrix(part.column("v"), centroids.shape[1]))
                apart = np.arccos(np.clip(m @ centroids.T, -1, 1)) - reach
                open_ = (np.cos(np.maximum(apart, 0)) >= least - 1e-6) & (reach >= 0)
                ends = np.concatenate([[0], np.cumsum(open_.sum(axis=1))]).astype(np.int32)
                cells = pa.ListArray.from_arrays(ends, pa.array(np.nonzero(open_)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, "cells"])

    return run


def _angles(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = unit(matrix(batch.column("v"), centroids.shape[1])) @ centroids.T
            own = near[np.arange(len(near)), batch.column("cell").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(np.arccos(np.clip(own, -1, 1)))], names=["cell", "angle"])

    return run


def reach_of(index: Index) -> np.ndarray:
    """The largest angle between each cell's rows and its centroid; below zero for a cell without rows. What comes to the driver is a row for each cell."""
    angles = index.rows.select("cell", "v").mapInArrow(_angles(index.centroids), "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("reach"))
    reach = np.full(len(index.centroids), -1.0)
    for r in angles.collect():
        reach[r["cell"]] = r["reach"] + 1e-9
    return reach


def pairs_over(index: Index, least: float, flat: bool | None = None) -> DataFrame:
    """a, b, similarity of all pairs of rows, a < b, with a cosine of ``least`` (above zero) at least. Exact: no pair is lost.

    A row visits every cell that could have a row so near: the angle between it
    and the centroid, less the largest angle within the cell, bounds what it
    can find there. Where that leaves nearly all cells, rows are dealt to large
    lists, every two of which meet once; flat says which, by default what sends
    fewer rows. Rows of equal vectors make a pair each; group them before.
    """
    if least <= 0:
        raise ValueError("least must be above zero")
    spark, width = index.rows.sparkSession, index.centroids.shape[1]
    ship_package(spark)
    reach = reach_of(index)
    kind = index.rows.schema["id"].dataType.simpleString()
    visiting = index.rows.select("id", "v", "tag").mapInArrow(_cells_within(index.centroids, reach, least), f"id {kind}, v array<double>, tag string, cells array<int>")
    if flat is None:
        n, visits = visiting.agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
        flat = n * max(1, n / blocks.LIST) <= 2 * visits
    if flat:
        return blocks.pairs_of_all(index.rows.select("id", "v"), width, least)
    visiting = cut(visiting.select("id", "v", "tag", F.explode("cells").alias("cell")))
    asking = packed(visiting, QUERIES_AT_ONCE, width).select("cell", F.col("ids").alias("ids_y"), F.col("flat").alias("flat_y"))
    lists = packed(index.rows, ROWS_AT_ONCE, width).select("cell", "ids", "flat")
    return lists.join(asking, "cell").mapInArrow(blocks.near_pairs(width, least, once=False), f"a {kind}, b {kind}, similarity double")
