"""Every query that has SQL gives the rows of that SQL in DuckDB."""

import os

import duckdb
import pytest

from factweave.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_state_what_they_cover():
    assert set(registry.COVERS) == set(registry.QUERIES)
    assert all(registry.COVERS.values())
