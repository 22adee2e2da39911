"""Anchors of questions are looked for in the ids of all documents."""

import datetime

import duckdb

from factweave.plans import registry

registry.load()


def test_question_anchors_reads_every_kind_of_id(spark, tmp_path):
    day = datetime.date(1995, 1, 1)
    keys = [*range(0, 4000), 31, 31, 51, None, None]  # ids of several rows, and none
    orders = [(k, day) for k in keys] + [(531 * 4, datetime.date(2031, 5, 5)), (12, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(n,) for n in [*range(0, 900), 40, None]], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    connection = duckdb.connect()
    for t in ("orders", "supplier"):
        connection.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = connection.sql(registry.ORACLE_SQL["question_anchors"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["question_anchors"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {doc % 4 for _, doc, _ in got} >= {0, 2}  # ids that begin with dual or AC
