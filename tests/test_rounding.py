"""Means that lie between two six-digit numbers are rounded as in the SQL."""

import datetime

import duckdb

from factweave.plans import registry

registry.load()

# Order lines of part 369 of sf0.1: hundredths of discount, line.
LINES = [(7, 3), (7, 1), (10, 7), (9, 1), (8, 7), (9, 4), (10, 4), (9, 5), (4, 5), (9, 2), (6, 5), (4, 4), (9, 7), (9, 6), (3, 6), (4, 7), (9, 5), (5, 3), (5, 3), (8, 6), (9, 2), (2, 3), (7, 7), (10, 6), (1, 2), (6, 7), (0, 2), (7, 5), (1, 6), (2, 7), (8, 3), (7, 6)]


def test_multi_mention_scores_rounds_like_its_sql(spark, tmp_path):
    rows = [(i, 369, 1, line, d / 100, 0.0, "N", 5.0, datetime.date(1995, 1, 1)) for i, (d, line) in enumerate(LINES)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string, l_quantity double, l_shipdate date"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    connection = duckdb.connect()
    connection.sql("set threads = 1")
    connection.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = connection.sql(registry.ORACLE_SQL["multi_mention_scores"]).fetchall()
    assert [tuple(r) for r in registry.QUERIES["multi_mention_scores"](spark, str(tmp_path)).collect()] == want
    assert want[0][2] == 0.504062
