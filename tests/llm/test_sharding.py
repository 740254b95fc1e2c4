import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 23, 24, 25, 100, 997, 1024, 5000])
def test_permutation_is_a_bijection(spark, n):
    a, b = sharding.sides(n)
    assert a * b >= n and a * b - n < a + b
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert sum(x == i for i, x in enumerate(got)) < n // 10
        other = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 99).alias("p")).collect()]
        assert other != got


def check(rows, texts):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    data = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r.size, r.text_crc32) for r in rows) == data


def test_real_rows_in_any_partitioning(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    check(rows, [r.text for r in docs.collect()])
    again = sharding.shard(docs.repartition(7, "lang")).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_edge_cases(nasty, nothing):
    check(sharding.shard(nasty).collect(), [r.text for r in nasty.collect()])
    assert sharding.shard(nothing).count() == 0


def test_no_python_in_the_plan(nasty):
    plan = sharding.shard(nasty)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_rows_that_are_all_the_same(spark):
    docs = spark.createDataFrame([(None, "same")] * 500 + [(i, "x" * i) for i in range(100)], "doc_id long, text string").repartition(5)
    rows = sharding.shard(docs).collect()
    check(rows, [r.text for r in docs.collect()])
    sized = docs.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    numbers = lambda chunk: sorted((r.number, r.text_crc32) for r in sharding.numbered(sized, chunk=chunk)[0].collect())
    assert numbers(7) == numbers(sharding.CHUNK) and [n for n, _ in numbers(7)] == list(range(600))
