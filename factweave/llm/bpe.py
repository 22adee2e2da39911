"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each token's bytes become characters, one for each byte, and the token a piece
with score -rank: sentencepiece merges the pair with the best score first, and
of equal ones the leftmost, which is what merging by ranks does. Nothing is
trained. Text is split into pre-tokens by a pattern, and each is encoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: The character that stands for byte b is chr(FIRST_CHAR + b): letters that no normalisation touches.
FIRST_CHAR = 0x4E00
#: Pre-tokens whose ids a worker remembers, and the longest of these.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: bytes by length, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def as_chars(data: bytes) -> str:
    return "".join([chr(FIRST_CHAR + b) for b in data])


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model: pieces, BPE as its type, identity as its normalisation. Piece 0 is unknown; rank r is piece r + 1."""
    unknown, bpe = 2, 2
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, _field(1, as_chars(token).encode()) + _field(2, -float(rank))))
    trainer = _field(2, _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1))
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + trainer + _field(3, plain)


class ByteBpe:
    """Encodes text to ids (the ranks) and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0 .. n - 1")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.seen: dict[str, tuple[int, ...]] = {}
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode_token(self, token: str) -> tuple[int, ...]:
        """A pre-token that is in the vocabulary is one id; all others are merged."""
        data = token.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(i - 1 for i in self.model.encode(as_chars(data)))
        if len(token) <= LONGEST_REMEMBERED:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[token] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        seen, ids = self.seen.get, []
        for token in self.find(text):
            ids.extend(seen(token) or self.encode_token(token))
        return np.array(ids, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not ends.size:
            return b""
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[np.arange(ends[-1]) + shift].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


ENCODED = "doc_id long, ids array<int>, n_tokens long, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = public_tokenizers.PATTERN,
    digests: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_tokens, decoded; with digests, these in place of ids and bytes.

    Whole texts are encoded, null as the empty text, which has no ids. Special
    tokens' strings are ordinary text. Repeated rows are encoded one by one.
    vocabulary: a rank file of the installed tokenizer package, which every
    worker reads from its own installation.
    """
    small_batches(docs.sparkSession)
    numerals = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(public_tokenizers.path(vocabulary), pattern)
        decimal = [str(i) for i in range(min(numerals, bpe.lengths.size))]
        for batch in batches:
            n, out, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                data = bpe.decode(ids)
                n.append(ids.size)
                if digests:
                    out.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(data).hexdigest())
                else:
                    out.append(ids.astype(np.int32))
                    decoded.append(data)
            counts = pa.array(n, pa.int64())
            if digests:
                columns = [batch.column(0), counts, pa.array(out, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                columns = [batch.column(0), pa.array(out, pa.list_(pa.int32())), counts, pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, DIGESTS if digests else ENCODED)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)


def stage_byte_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row."""
    return encode_decode(docs).select("doc_id", "n_tokens", "ids")
