import math

import numpy as np
import pytest

from caseloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, extra string, score double, uid string"


def by_hand(rows):
    """The definition, anchor by anchor."""
    live = []
    for vid, e, label in rows:
        if label is None or e is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        live.append((vid, [math.floor(256 * x) for x in e], (label + 1) % 10 if vid is not None and vid % 7 == 0 else label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (vid, a, label) in enumerate(live):
        if vid is None or vid % 100:
            continue
        got = [(sum(p * q for p, q in zip(a, x, strict=True)), v, lab) for j, (v, x, lab) in enumerate(live) if j != k and len(x) == len(a)]
        positives = sorted((r for r in got if r[2] == label), key=order)[:5]
        others = sorted((r for r in got if r[2] != label), key=order)
        for p, pid, _ in positives:
            inside = [r for r in others if 80 * p <= 100 * r[0] <= 100 * p][:5]
            out += [(vid, pid, n, r[1], p, r[0]) for n, r in enumerate(inside, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.5, "u") for r in rows], SCHEMA)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_brute_force(spark, data, sf):
    table = spark.read.parquet(f"{data}/{sf}/embeddings.parquet")
    want = by_hand([(r.vec_id, r.embedding, r.label) for r in table.collect()])
    assert len(want) > 20 and got(negatives.mine(table)) == want


@pytest.mark.parametrize("width", [1, 3, 8])
def test_ties_copies_and_odd_rows(spark, width, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "BLOCK", 50)
    rng = np.random.default_rng(width)
    rows = [(int(v), [float(x) for x in rng.integers(-3, 4, width) / 4], int(rng.integers(0, 3))) for v in rng.integers(0, 1200, 700)]
    rows += [(100, [0.5] * width, 1)] * 40 + [(None, [0.5] * width, 2)] * 7 + [(200 + k, [0.5] * width, 2) for k in range(9)]
    rows += [(300, None, 1), (400, [None] * width, 1), (500, [math.nan] * width, 1), (600, [math.inf] * width, 1), (700, [1.0] * width, None), (800, [], 1), (900, [0.25] * (width + 1), 1), (901, [0.25] * (width + 1), 2), (903, [0.25] * (width + 1), 1)]
    assert got(negatives.mine(frame(spark, rows).repartition(5))) == by_hand(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(0, 3e4, 5)], int(k % 3)) for k in range(0, 400, 4)]
    assert got(negatives.mine(frame(spark, rows))) == by_hand(rows)


def test_nothing(spark):
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [(100, [1.0], 1)])).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (v := rng.normal(size=(4000, 33))) / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    cells = negatives.Cells(x.min(axis=0), x.max(axis=0), x[:500])
    upper, lower = (negatives.bounded(cells.codes(x), cells.tables(x[:20], up)) for up in (True, False))
    score = x @ x[:20].T
    assert (lower <= score).all() and (score <= upper).all()
    assert (upper >= np.sort(score, axis=0)[-6]).mean() < 0.2  # few pairs are left to score


def test_sql_states_odd_rows_too(spark, tmp_path):
    import duckdb

    from caseloom.llm import oracle

    rows = [(k % 300, [((k * j) % 7 - 3) / 4 for j in range(1, 5)], k % 3) for k in range(900)]
    rows += [(100, None, 1), (None, [0.5] * 4, 1), (200, [0.5, None, 1.0, 1.0], 1), (100, [math.nan] * 4, 1), (100, [0.5] * 4, None), (0, [], 1)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(oracle.hard_negatives())
    columns = [c[0] for c in want.description]
    out = negatives.mine(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    assert sorted(map(repr, (tuple(r) for r in out.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
