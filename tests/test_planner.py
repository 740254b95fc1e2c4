"""Queues of any length."""

import duckdb
import pytest
from pyspark.sql import functions as F

from caseloom import plans
from caseloom.operators import planner


def test_places_go_on_over_partitions(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("id"), (F.col("id") % 3).alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several sorted partitions
    try:
        out = planner.placed(rows.orderBy("k", "id"), f"{tmp_path}/queue")
        got = [(r.place, r.k, r.id) for r in out.orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == [(i, k, n) for i, (k, n) in enumerate(sorted((r.k, r.id) for r in rows.collect()), 1)]


@pytest.mark.parametrize("suppliers", [0, 300])
def test_the_whole_queue_has_places(spark, tmp_path, suppliers):
    spark.range(suppliers).select(F.col("id").alias("s_suppkey"), (F.col("id") * 31 % 97).cast("double").alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in plans.queries()["forum_queue"](spark, str(tmp_path)).select("id", "place").collect())
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == sorted(con.execute(f"select id, place from ({plans.oracle_sql()['forum_queue']})").fetchall())
    assert len(got) > 100 or not suppliers
