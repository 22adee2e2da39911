"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints come from hashed word shingles. To find all pairs within a radius
r, each bit position gets a code of r + 1 bits; each of the 2^(r+1) - 1 masks
keeps the positions whose code has an odd product with it. For up to r
differing positions some mask's number is orthogonal to all their codes, so
the mask keeps none of them, and that pair has equal masked values in that
mask's table: no pair is missed.

Buckets are worked on without listing all pairs. Distinct fingerprints come
first (equal ones need no comparison). A small bucket's fingerprints are
compared with one another; a larger bucket is dealt again by covering masks
over the bits that are still free, and again, until buckets are small or no bit
is free. Each level halves the free bits, so a bucket of distinct fingerprints
can't stay large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, small_batches, table, with_row_key, without_ids
from .components import connected_components
from .covering import covering_masks, majority, near_edges, signed
from .similar import similar_groups

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text: of its 64 bits, one is set where over half the shingles' hashes have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    hashed = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    return majority(hashes)


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column(1)]
        signed = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a long or a struct that is ordered, and fp, the fingerprint as a signed long, of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    own = F.col(id_col) if isinstance(kind, StructType) else F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(fingerprint_batches, StructType([rows.schema["doc_id"]]).add("fp", "long"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, small: int = 64
) -> DataFrame:
    """One row per document: doc_id, fp, component_id, the smallest id that links of up to ``radius`` bits reach.

    Null texts and texts without words have fingerprint zero and are linked
    like any other; of shorter texts than a shingle the whole is hashed. Rows
    that repeat an id count one by one; rows with null ids get the component of
    their fingerprint, null if it has no id. An empty table gives no rows.
    """
    docs_fp = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    least = materialize(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs")), "distinct-fp")
    parts = materialize(connected_components(near_edges(least, radius, small)), "components")
    linked = parts.join(least, parts["node"] == least["fp"]).select("fp", "component", "least")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(smallest, "component").select("fp", "component_id")
    alone = least.filter("docs > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    known = materialize(linked.unionByName(alone).withColumnRenamed("fp", "_fp"), "fp-components")
    joined = docs_fp.join(known, docs_fp["fp"] == known["_fp"], "left")
    return joined.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_simhash(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest id.

    Near are documents whose sets of five-word shingles have a similarity of
    0.8 or more, and groups are what such links join. SimHash fingerprints of
    these sets find links first, by covering masks; such pairs may differ in
    more bits than masks can cover, so the rest is looked for by an exact way
    among what the fingerprints have not joined (see similar.py).
    Documents without words are one group. Rows that repeat an id, null among
    them, count one by one; a null id loses against any other.
    """
    rows, row = with_row_key(docs, "doc_id", nulls_first=False)
    dropped = similar_groups(rows, row).filter("not key <=> component").select("key")
    return without_ids(rows, materialize(dropped, "near-duplicates"), row).drop(row)
