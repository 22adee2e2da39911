"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent n-grams. A document's own
list is compared with each profile by the out-of-place distance: the sum, over
the document's n-grams, of how far apart the two ranks are, with the most
possible for an n-gram that the profile lacks (Cavnar and Trenkle).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, small_batches, table, with_row_key, without_ids

#: n-grams have 1 to GRAMS characters; three code points of 21 bits fill a long.
GRAMS = 3
EDGE = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a blank."""
    codes = np.full(0x110000, EDGE, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            codes[cp] = ord(low) if len(low) == 1 else cp
    return codes


def letters(text: str) -> np.ndarray:
    """The letters in lower case as code points, each run of others as one blank, a blank at either end; empty if no letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([EDGE], _letter_table()[raw], [EDGE]))
    codes = codes[np.concatenate(([True], (codes[1:] != EDGE) | (codes[:-1] != EDGE)))]
    return codes.astype(np.int64) if codes.size > 1 else codes[:0].astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams as numbers, without the single blank, and their counts."""
    c = letters(text)
    found, counts = [], []
    for n in range(1, GRAMS + 1):
        if c.size < n:
            break
        code = c[: c.size - n + 1].copy()
        for i in range(1, n):
            code = (code << 21) | c[i : c.size - n + 1 + i]
        values, times = np.unique(code, return_counts=True)
        keep = values != EDGE
        found.append(values[keep])
        counts.append(times[keep])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(counts)


def ranked(values: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, by count and then by number."""
    if values.size > top:
        least = np.partition(counts, values.size - top)[values.size - top]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:top]


def classify(text: str | None, profiles: list[tuple[str, np.ndarray, np.ndarray]], top: int) -> tuple[str, float]:
    """profiles: (language, its n-grams in ascending order, their ranks), by language."""
    values, counts = gram_counts(text) if text else (np.zeros(0, np.int64), None)
    if not values.size or not profiles:
        return UNKNOWN, 0.0
    own = ranked(values, counts, top)
    ranks = np.arange(own.size)
    best, least = UNKNOWN, None
    for lang, grams, places in profiles:
        at = np.minimum(np.searchsorted(grams, own), grams.size - 1)
        distance = int(np.where(grams[at] == own, np.minimum(np.abs(places[at] - ranks), top), top).sum())
        if least is None or distance < least:
            best, least = lang, distance
    return best, 1.0 - least / (top * own.size)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for the documents from which nothing is learnt; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1)
        for lang in sorted(set(langs)):
            found = [gram_counts(texts[i].as_py()) for i, x in enumerate(langs) if x == lang]
            values, inverse = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in found]), values.size).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * values.size, pa.string()), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"]
            )


def learn_profiles(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, top: int, sample: int
) -> dict[str, list[int]]:
    """Each language's ``top`` most frequent n-grams, from about ``sample`` of its rows, chosen by a hash of the id.

    What comes to the driver is ``top`` numbers for each language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("lang is not null and text is not null").filter(~held_out(F.col("id")))
    shares = {r["lang"]: min(1.0, sample / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    counts = chosen.select("lang", "text").mapInArrow(_count_batches, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("gram")))), 1, top)
    # First within parts of a language's n-grams, then over the parts' best.
    parts = totals.groupBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64)).alias("part")).agg(best.alias("best"))
    flat = parts.select("lang", F.explode("best").alias("b")).select("lang", "b.n", "b.gram").withColumn("n", -F.col("n"))
    return {r["lang"]: [x["gram"] for x in r["best"]] for r in flat.groupBy("lang").agg(best.alias("best")).collect()}


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    top: int = 400,
    sample: int = 2000,
    key_col: str | None = None,
    give_lang: bool = False,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    key_col: the column to give as doc_id, if not the id. give_lang: adds lang,
    the given one, which no prediction reads.

    Profiles come from the labelled documents that are not held out (crc32 of
    the id, in fifths), from about ``sample`` of each language. score is 1 minus
    the share of the largest possible distance; of equal distances the first
    language counts. A null text or one without letters is ``und`` with score
    0, and so is every text where nothing could be learnt. Whole texts are
    read. Rows with null ids are held out; repeated rows get equal answers; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    learnt = learn_profiles(docs, id_col, text_col, lang_col, top, sample)
    profiles = []
    for lang in sorted(learnt):
        grams = np.array(learnt[lang], np.int64)
        order = np.argsort(grams)
        profiles.append((lang, grams[order], order))
    profiles = [p for p in profiles if p[1].size]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [classify(t.as_py(), profiles, top) for t in batch.column(2)]
            found = [pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found, *batch.columns[3:]], names=names)

    key = F.col(f"`{key_col}`") if key_col else F.col(id_col).cast("long")
    rows = docs.select(
        key.alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), *([F.col(lang_col).alias("lang")] if give_lang else [])
    )
    schema = StructType([rows.schema["doc_id"]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    if give_lang:
        schema = schema.add("lang", "string")
    names = schema.names
    return rows.mapInArrow(predict, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


#: A text whose score is under this share of the least that a rightly recognised labelled document has is in no known language.
FAR = 0.5


def stage_language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no known language is found: null texts, texts without letters, and texts far from every profile.

    How far is far follows from the labelled documents that are not held out:
    the least score of those whose language is recognised, times FAR. Where
    none is recognised, only texts without letters go. The others stay as they
    are, with the language that they came with. Rows that repeat an id, null
    among them, are judged one by one.
    """
    rows, row = with_row_key(docs, "doc_id")
    said = materialize(identify(rows, key_col=row, give_lang=True), "languages")
    least = said.filter("not held_out and lang = lang_pred").agg(F.min("score")).first()[0]
    gone = said.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < FAR * (least or 0.0))).select("doc_id")
    return without_ids(rows, materialize(gone, "rejected"), row).drop(row)  # written, so that few ids are broadcast by their size
