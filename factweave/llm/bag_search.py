"""Ranked lexical search over deduplicated bags of words.

Documents are restricted to the vocabulary of the items: what is left of a
text is its vector of term frequencies, and m, which its length gives. Texts
with the same vector and the same m have the same score for every item; such a
class is found by a hash and told from others by its whole content, and it is
scored once. An item's best classes, by score and then by their smallest id,
hold its best documents; the members of only these are looked up, in ascending
order of their ids.

The vocabulary goes to the tasks in parts of a bounded number of terms, and
the items in blocks of a bounded number of postings; what comes to the driver
at once is one part or one block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, small_batches, table
from .maxscore import best

#: Terms of the vocabulary that a task holds at once.
TERMS = 1 << 18
#: Postings (item, term) that a task holds at once.
POSTINGS = 1 << 20
#: Scores (class, item) that are worked out at once.
SCORES = 1 << 21

#: What stands for each byte: letters and digits of ASCII, capitals made small, and all other bytes above it stay; the rest parts terms.
KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
LAST = (1 << 63) - 1


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters outside of ASCII, with A-Z lower-cased."""
    return (text or b"").translate(KEPT).split()


def encoded(numbers: list[int], counts: list[int]) -> bytes:
    """A vector of term frequencies in the narrowest whole numbers that hold it, so that equal vectors have equal bytes."""
    if not numbers:
        return b""
    width = lambda most: next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    a, b = width(max(numbers)), width(max(counts))
    return bytes((a, b)) + np.array(numbers, f"<u{a}").tobytes() + np.array(counts, f"<u{b}").tobytes()


def decoded(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not vector:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = vector[0], vector[1]
    n = (len(vector) - 2) // (a + b)
    return np.frombuffer(vector, f"<u{a}", n, 2).astype(np.int64), np.frombuffer(vector, f"<u{b}", n, 2 + n * a).astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """key, term, times: the terms of each item's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, t, n) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, n in Counter(terms(text)).items()]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], names=["key", "term", "times"])

    return items.select("key", F.col("text").cast("binary")).mapInArrow(run, "key long, term binary, times long")


def _restrict(vocabulary: dict[bytes, int]):
    """Adds to each text's vector what it has of this part of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, vectors = [], []
            for text, vector in zip(batch.column("text"), batch.column("vector").to_pylist()):
                found = terms(text.as_py())
                counts = sorted(Counter(x for x in map(vocabulary.get, found) if x is not None).items())
                numbers, times = (c.tolist() for c in decoded(vector))
                sizes.append(len(found))
                vectors.append(encoded(numbers + [k for k, _ in counts], times + [n for _, n in counts]))
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n", "vector"])

    return run


def restricted(docs: DataFrame, vocabulary: DataFrame, parts: int) -> DataFrame:
    """doc_id, n, vector of every document with a term; vocabulary: part, term, number, with numbers ascending by part."""
    rows = docs.withColumn("n", F.lit(0).cast("long")).withColumn("vector", F.lit(b""))
    for part in range(max(parts, 1)):
        if part:  # a task holds one part only
            rows = materialize(rows, "texts")
        known = {bytes(r["term"]): r["number"] for r in vocabulary.filter(F.col("part") == part).collect()}
        rows = rows.mapInArrow(_restrict(known), "doc_id long, text binary, n long, vector binary")
    return materialize(rows.filter("n > 0").select("doc_id", "n", "vector"), "restricted")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """number, df: how many documents have each term of the vocabulary; a task passes on one row for a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            found = [decoded(v)[0] for v in batch.column(0).to_pylist()]
            numbers, counts = np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
            total.update(dict(zip(numbers.tolist(), counts.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["number", "df"])

    return rows.select("vector").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))


class Scorer:
    """The best classes of each item of a block, over the classes that a task has met."""

    def __init__(self, postings: list[tuple[int, int, int]], k: int) -> None:
        """postings: number, item's key, weight times how often the item has the term."""
        self.keys = np.unique(np.array([key for _, key, _ in postings], np.int64))
        place = {key: i for i, key in enumerate(self.keys.tolist())}
        by: dict[int, tuple[list[int], list[int]]] = {}
        for number, key, weight in postings:
            own = by.setdefault(number, ([], []))
            own[0].append(place[key])
            own[1].append(weight)
        self.by = {number: (np.array(a), np.array(w, np.int64)) for number, (a, w) in by.items()}
        self.k = k
        self.found = [(np.empty(0, np.int64),) * 3 for _ in self.keys]  # score, smallest id, class

    def add(self, vectors: list[bytes], m: np.ndarray, least: np.ndarray, classes: np.ndarray) -> None:
        step = max(1, SCORES // max(len(self.keys), 1))
        for i in range(0, len(vectors), step):
            self._add(vectors[i : i + step], m[i : i + step], least[i : i + step], classes[i : i + step])

    def _add(self, vectors, m, least, classes) -> None:
        parts = [decoded(v) for v in vectors]
        row = np.repeat(np.arange(len(parts)), [p[0].size for p in parts])
        number, tf = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
        order = np.argsort(number, kind="stable")
        number, row, impact = number[order], row[order], impact[order]
        ends = np.flatnonzero(np.diff(number)) + 1
        scores = np.zeros((len(self.keys), len(parts)), np.int64)
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), number.size]):
            if a < b and int(number[a]) in self.by:
                items, weights = self.by[int(number[a])]
                scores[items[:, None], row[None, a:b]] += weights[:, None] * impact[None, a:b]
        for j, own in enumerate(self.found):
            floor = own[0][-1] if own[0].size == self.k else 1
            at = np.flatnonzero(scores[j] >= floor)
            if at.size:
                score, first, number = (np.concatenate(x) for x in zip(own, (scores[j][at], least[at], classes[at])))
                top = best(score, first, self.k)
                self.found[j] = score[top], first[top], number[top]

    def rows(self) -> pa.RecordBatch:
        sizes = [f[0].size for f in self.found]
        columns = [np.repeat(self.keys, sizes), *(np.concatenate([f[i] for f in self.found] or [np.empty(0, np.int64)]) for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "score", "least", "class"])


def best_classes(classes: DataFrame, postings: DataFrame, items: int, k: int) -> DataFrame:
    """key, score, least, class: candidates for each item's k best classes, from every task; items in blocks of a bounded number of postings."""

    def scored(block: list[tuple[int, int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(block, k)
            for batch in batches:
                m, least, own = (batch.column(c).to_numpy() for c in ("m", "least", "class"))
                if len(m):
                    scorer.add(batch.column("vector").to_pylist(), m, least, own)
            yield scorer.rows()

        return run

    cells = classes.select("vector", "m", F.coalesce("least", F.lit(LAST)).alias("least"), "class")
    blocks = max(1, -(-items // POSTINGS))
    out = None
    for i in range(blocks):
        block = [tuple(r) for r in postings.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).select("number", "key", "weight").collect()]
        found = cells.mapInArrow(scored(block), "key long, score long, least long, class long")
        if blocks > 1:
            found = materialize(found, "best-classes")
        out = found if out is None else out.unionByName(found)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents with the highest scores above zero, equal ones by ascending id.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is
    75 + (25 * n * N) div L, and its score for an item the sum of weight *
    ((10^9 * tf) div (1000 * tf + 12 * m)) over the item's terms, repeats
    included; N documents have terms, n of them this one, L all of them.

    Texts that are null or have no term take no part; items without a term have
    no result. Rows that repeat a document's id count one by one; a null id
    comes after all others. Rows that repeat an item's id are items of their
    own. Whole texts are read. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = materialize(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).withColumn("key", F.monotonically_increasing_id()), "items")
    asked = materialize(item_terms(own), "item-terms")
    distinct = materialize(asked.select("term").distinct(), "vocabulary-terms")
    parts = -(-distinct.count() // TERMS)
    part = F.pmod(F.xxhash64("term"), F.lit(max(parts, 1))).cast("long").alias("part")
    place = F.row_number().over(Window.partitionBy("part").orderBy("term")).cast("long") - 1
    vocabulary = distinct.select("term", part).withColumn("number", (F.col("part") * (1 << 32)) + place)
    vocabulary = materialize(vocabulary, "vocabulary")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = restricted(texts, vocabulary, parts)
    whole = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    whole = materialize(whole, "corpus")
    df = materialize(document_frequencies(rows), "frequencies")
    weight = F.floor(1000 * F.log((2.0 * F.col("docs") + 2) / (2.0 * F.col("df") + 1)))
    weights = df.crossJoin(F.broadcast(whole)).select("number", weight.alias("w"))  # whole is one row
    postings = asked.join(vocabulary, "term").join(weights, "number").select("number", "key", (F.col("w") * F.col("times")).alias("weight"))
    postings = materialize(postings, "item-postings")

    m = F.expr("75 + (25 * n * docs) div total")
    bags = rows.crossJoin(F.broadcast(whole)).select("doc_id", m.alias("m"), "vector").filter(F.length("vector") > 0)
    bags = bags.withColumn("h", F.xxhash64("vector", "m"))
    classes = bags.groupBy("h", "m", "vector").agg(F.min("doc_id").alias("least"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    order = Window.partitionBy("key").orderBy(F.desc("score"), "least", "class")
    chosen = best_classes(classes, postings, postings.count(), k).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    chosen = materialize(chosen.select("key", "score", "class"), "chosen-classes")
    looked = materialize(classes.join(chosen.select("class").distinct(), "class").select("class", "h", "m", "vector"), "looked-up")
    first = Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id"))
    members = bags.join(looked, ["h", "m", "vector"]).select("class", "doc_id").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)
    ranks = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = chosen.join(members, "class").withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
    return found.join(own.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN c GROUP BY term, docs),
m AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM n CROSS JOIN c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""


def op13_bag_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
