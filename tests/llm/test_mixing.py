import re

import pytest
from pyspark.sql import functions as F

from caseloom.llm import mixing


def shares(sizes):
    """Weights 5, 2, 1 in turn; excess over three times a size goes on by weight until none is left."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, list(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000}, {"a": 1, "b": 1, "c": 1, "d": 5000, None: 3}, {"a": 7}, {"a": 0, "b": 9}, {"a": 0}, {f"s{k:02d}": (k * 37) % 101 + 1 for k in range(40)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "__source string, __size long")
    got = {r["__source"]: r["__target"] for r in mixing.targets(rows).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_words_count_like_the_pattern(spark):
    texts = ["", " ", None, "a b\tc\n\x0bd", "é x  y", "one"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.words("text").alias("n")).collect()
    assert [r.n for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_real_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.1/documents.parquet")
    rows = mixing.rates(docs).select("doc_id", "source", "__size", "__source_size", "__target", "__copies").toPandas()
    again = mixing.rates(docs.repartition(5)).select("doc_id", "__copies").toPandas()
    assert dict(zip(rows.doc_id, rows["__copies"], strict=True)) == dict(zip(again.doc_id, again["__copies"], strict=True))
    assert rows["__copies"].max() <= 3
    want = shares(rows.groupby("source")["__size"].sum().to_dict())
    rows["taken"] = rows["__size"] * rows["__copies"]
    for source, part in rows.groupby("source"):
        assert part["__target"].iloc[0] == pytest.approx(want[source])
        assert abs(part["taken"].sum() / want[source] - 1) < 0.15
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == rows["__copies"].sum()


def test_edge_cases(nasty, nothing):
    rows = mixing.rates(nasty).collect()
    assert len(rows) == 11 and all(0 <= r["__copies"] <= 3 for r in rows)
    out = mixing.mix(nasty)
    assert out.columns == nasty.columns and out.count() == sum(r["__copies"] for r in rows)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(nasty.where(F.col("text") == "")).count() == 0


def test_columns_of_any_name_stay_whole(spark):
    rows = [(k % 50, f"word {k % 7} and more", f"s{k % 3}", -7, "mine", 2.5, k % 2 == 0, "k", bytes([k % 3])) for k in range(300)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "__size", "__copy", "a.b", "__key", "__row", "c0"])
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    mixed = [tuple(r) for r in out.collect()]
    assert set(mixed) <= set(rows) and len(mixed) == sum(r["__copies"] for r in mixing.rates(docs).collect())


def test_a_third_of_equal_rows_fills_all_strata_alike(spark):
    docs = spark.range(30_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("the same words")).otherwise(F.concat(F.lit("other words "), F.col("id").cast("string"))).alias("text"),
        F.lit("a").alias("source"),
    )
    digest = F.md5(F.col("text").cast("binary")).alias("__digest")
    classes = docs.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), mixing.words("text").alias("__size"), digest)
    drawn = mixing.drawn(classes.groupBy(*classes.columns).agg(F.count(F.lit(1)).alias("__n")), stratum=1000)
    strata = drawn.groupBy("__stratum").agg(F.sum("__m").alias("n")).toPandas()["n"]
    assert strata.sum() == 30_000 and strata.max() < 2 * strata.median()
    rows = mixing.rates(docs, stratum=1000).toPandas()
    assert len(rows) == 30_000 and (rows["__size"] * rows["__copies"]).sum() == pytest.approx(90_000, rel=0.01)
    mixed = mixing.mix(docs, stratum=1000)
    assert abs(mixed.count() - rows["__copies"].sum()) <= 30
