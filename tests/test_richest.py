"""Richest cases of clusters, against a walk over plain rows; large tables are dealt once."""

import random

from pyspark.sql import functions as F

from caseloom import plans
from caseloom.operators import dedup


def by_hand(cases, clusters):
    of = {}
    for thread, size, judged in clusters:
        for c, places in enumerate(judged):
            for i in places:
                if thread is not None and 0 <= i < size:
                    of[thread, i] = min(c, of.get((thread, i), c))
    found = [(t, i) for t, i in of if sum(k[0] == t and c == of[t, i] for k, c in of.items()) >= 2]
    of = {k: of[k] for k in found}
    best = {}
    for t, i, r in cases:
        if (t, i) in of:
            key = (t, of[t, i])
            best[key] = max(best.get(key, (-1, 0)), (r, -i))
    return sorted(((t, i) for t, i, _ in cases if (t, i) not in of or best[t, of[t, i]][1] == -i), key=str)


def test_keep_richest_by_hand(spark):
    rng = random.Random(5)
    cases = [(t, i, rng.randrange(3)) for t in (None, *range(40)) for i in range(rng.randrange(9))] + [(7, 0, 1), (None, 2, 1)]
    clusters = [(t, rng.randrange(10), [[rng.randrange(-1, 10) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(4))]) for t in (None, *range(30), 3, 4)]
    rows = spark.createDataFrame(cases, "thread_id long, idx int, r int").select("thread_id", "idx", F.struct("r").alias("richness"))
    judged = spark.createDataFrame(clusters, "thread_id long, size int, clusters array<array<int>>")
    want = by_hand(cases, clusters)
    for deal in (lambda df: df, lambda df: dedup.by_thread(df, 7)):
        got = dedup.keep_richest(deal(rows), dedup.cluster_members(deal(judged)))
        assert got.columns == ["thread_id", "idx", "richness"]
        assert sorted(((r.thread_id, r.idx) for r in got.collect()), key=str) == want and len(want) < len(cases)


def test_tasks_of_keep_richest_go_with_its_rows(spark, data, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS_A_TASK", 5_000, raising=False)
    rows = spark.read.parquet(f"{data}/sf0.01/lineitem.parquet").count()
    plan = plans.queries()["keep_richest"](spark, f"{data}/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {-(-rows // 5_000)}), REPARTITION_BY_NUM") == 2
    assert "ENSURE_REQUIREMENTS" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS", "")
