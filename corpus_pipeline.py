"""From raw documents to token ids, in five stages, each of which works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm.bpe import stage_byte_bpe
from factweave.llm.common import materialize, table
from factweave.llm.exact_dedup import stage_exact_dedup
from factweave.llm.langid import stage_language_id
from factweave.llm.mixing import stage_mix
from factweave.llm.simhash import stage_simhash

STAGES = [
    ("language_id", stage_language_id),
    ("exact_dedup", stage_exact_dedup),
    ("simhash_near_dedup", stage_simhash),
    ("source_mixing", stage_mix),
    ("byte_bpe", stage_byte_bpe),
]

#: Fingerprints, profiles and token ids have no form in SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mix: doc_id, n_tokens, ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
