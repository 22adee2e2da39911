"""Chunks of a document's items, worked out within the document's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<done:array<struct<kind:string,first:bigint,last:bigint,chars:bigint>>,buffer:array<struct<pos:bigint,chars:bigint>>>"


def type_aware_chunks(items: DataFrame, doc_col: str = "doc_id", size: int = 3000, overlap: float = 0.15) -> DataFrame:
    """items: doc_id, pos, kind, line. One row per chunk: doc_id, chunk, kind, first, last (positions), chars.

    Narrative items (headings and paragraphs) gather until they have ``size``
    characters; the last ``overlap`` of them, one at least, open the next chunk.
    A table row or code item closes what was gathered and is a chunk of its
    own. Document by document, so the state is as large as a document.
    """
    lists = items.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", F.length("line").cast("long").alias("chars")))).alias("items"))
    total = lambda buffer: F.aggregate(buffer, F.lit(0).cast("long"), lambda a, x: a + x["chars"])

    def closed(s: Column) -> Column:
        """What is done, with the buffer as a chunk if it has items."""
        buffer = s["buffer"]
        made = F.struct(F.lit("narrative").alias("kind"), buffer[0]["pos"].alias("first"), F.element_at(buffer, -1)["pos"].alias("last"), total(buffer).alias("chars"))
        return F.when(F.size(buffer) > 0, F.concat(s["done"], F.array(made))).otherwise(s["done"])

    def step(s: Column, item: Column) -> Column:
        buffer = F.concat(s["buffer"], F.array(F.struct(item["pos"].alias("pos"), item["chars"].alias("chars"))))
        grown = F.struct(s["done"].alias("done"), buffer.alias("buffer"))
        keep = F.greatest(F.lit(1), F.floor(F.size(buffer) * overlap).cast("int"))
        full = F.struct(closed(grown).alias("done"), F.slice(buffer, F.size(buffer) - keep + 1, keep).alias("buffer"))
        own = F.struct(item["kind"].alias("kind"), item["pos"].alias("first"), item["pos"].alias("last"), item["chars"].alias("chars"))
        alone = F.struct(F.concat(closed(s), F.array(own)).alias("done"), F.slice(s["buffer"], 1, 0).alias("buffer"))
        return F.when(~item["kind"].isin("heading", "paragraph"), alone).when(total(buffer) >= size, full).otherwise(grown).cast(STATE)

    start = F.expr(f"cast(named_struct('done', array(), 'buffer', array()) as {STATE})")
    chunks = F.aggregate("items", start, step, closed)
    return lists.select(doc_col, F.posexplode(chunks).alias("chunk", "c")).select(doc_col, F.col("chunk").cast("long").alias("chunk"), "c.*")
