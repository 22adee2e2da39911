"""Words near one another: rows of one document, batches that end within it, and words that are too rare for any pair."""

import random

import duckdb
import pytest
from test_growth import shuffled

from factweave.operators import windows
from factweave.plans import registry

registry.load()


@pytest.mark.parametrize("at_once,row", [(1 << 18, 1 << 18), (40, 7)])
def test_rows_of_one_document_are_one_text(spark, tmp_path, monkeypatch, at_once, row):
    monkeypatch.setattr(windows, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(windows, "PAIRS_OF_A_ROW", row)
    monkeypatch.setattr(windows, "PAIRS_OF_A_PART", 300)
    rng = random.Random(5)
    words = ["sentence", "übermaßen", "Contract", "paragraph", "signature", "a", "of", "it", "the", "обязательно", *(f"onlyhere{i}" for i in range(30))]
    texts = [(rng.choice([None, *range(12)]), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 700])))) for _ in range(40)] + [(3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.sql(registry.ORACLE_SQL["window_co_occurrence"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["window_co_occurrence"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_pairs_of_rare_words_are_not_sent(spark, tmp_path):
    names = lambda i: " ".join(f"word{i}of{j}" for j in range(200))
    spark.createDataFrame([(i, names(i) + " everywhere altogether") for i in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows, size = shuffled(spark, "window_co_occurrence", str(tmp_path))
    assert [tuple(r) for r in rows] == [("altogether", "everywhere", 300, 300)]
    assert size < 4_000_000  # the words once, not a row for each pair
