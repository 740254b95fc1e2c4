import math
from fractions import Fraction

import numpy as np
import pytest

from caseloom.llm import whitening


@pytest.mark.parametrize("bits", [3, 19, 20, 21, 45, 61, 90])
def test_gram_is_exact(bits):
    rng = np.random.default_rng(bits)
    raw = np.array([[int(rng.integers(0, 1 << 30)) << max(0, bits - 30) | int(rng.integers(0, 1 << min(bits, 30))) for _ in range(5)] for _ in range(41)], object)
    y = np.array([[int(v) % (1 << bits) * (-1) ** int(rng.integers(2)) for v in row] for row in raw], object)
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening.gram(y if bits > 62 else y.astype(np.int64)).tolist() == want


def test_digits_add_up():
    values = np.array([0, -1, 5, -(1 << 130) + 7, (1 << 99) + 3], object)
    out = whitening.digits(np.arange(5), np.zeros(5, int), values, 5)
    back = {}
    for r in out.itertuples():
        back[r.i] = back.get(r.i, 0) + (int(r.value) << (whitening.DIGIT * r.digit))
    assert [back[k] for k in range(5)] == values.tolist()


def by_hand(rows):
    """Exact rational covariance, then its eigenvectors; the rows of a width are a list of their own."""
    out = {}
    live = [(v, [math.floor(64 * c) + 1_000_000 for c in e]) for v, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    for width in {len(x) for _, x in live}:
        part = [(v, x) for v, x in live if len(x) == width]
        n, sums = len(part), [sum(x[i] for _, x in part) for i in range(width)]
        y = [[n * x[i] - sums[i] for i in range(width)] for _, x in part]
        cov = [[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(width)] for i in range(width)]
        out[width] = n, {v: sum(c * c for c in r) for (v, _), r in zip(part, y, strict=True)}, np.array(cov), dict(zip((v for v, _ in part), y, strict=True))
    return out


def check(got, want):
    n, deviation, cov, y = want
    values = np.linalg.eigvalsh(cov)[::-1]
    some = min(32, int((values > whitening.TINY * values[0]).sum()))
    assert len(got) == len(y) * some and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert (got.deviation == got.vec_id.map(deviation)).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(table.columns) == list(range(1, some + 1))
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(share, values[:some] / values.sum(), rtol=1e-9)
    w = table.to_numpy()
    assert np.allclose(w.T @ w / n, np.eye(some), atol=1e-9)
    back = w * np.sqrt(values[:some])  # the projections hold what these components explain, and no more
    rows = np.array([[float(c) / n for c in y[v]] for v in table.index])
    assert np.allclose((back**2).sum(axis=0) / n, values[:some])
    direction = rows.T @ w / n / np.sqrt(values[:some])  # V u / e = u
    assert np.allclose(cov @ direction, direction * values[:some], atol=1e-8 * values[0])
    assert np.allclose(np.linalg.norm(direction, axis=0), 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_exact_arithmetic(spark, data, sf):
    table = spark.read.parquet(f"{data}/{sf}/embeddings.parquet")
    want = by_hand([(r.vec_id, r.embedding) for r in table.collect()])
    assert set(want) == {64}
    check(whitening.whiten(table).toPandas(), want[64])
    check(whitening.whiten(table.repartition(7)).toPandas(), want[64])


SCHEMA = "vec_id long, embedding array<double>, n long, component int, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "w") for r in rows], SCHEMA)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(k, [float(x) for x in rng.normal(3, 1, 3)]) for k in range(60)]
    two = [(100 + k, [float(k), 7.0]) for k in range(9)]  # the second dimension never varies
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [math.nan, 1.0, 1.0]), (203, [1.0, -math.inf, 1.0]), (204, []), (205, [4.0] * 5), (206, [4.0] * 5)]
    out = whitening.whiten(frame(spark, good + two + odd).repartition(4)).toPandas()
    want = by_hand(good + two)
    assert set(out.vec_id) == {v for v, _ in good + two}  # equal vectors alone have no component
    check(out[out.vec_id < 100], want[3])
    check(out[out.vec_id >= 100], want[2])


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [2.0, 1.0]), (None, [5.0, 5.0]), (1, [1.0, 2.0])]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in out) == [(False, 1, 1)] * 3 + [(False, 1, 2)] * 3 + [(True, None, 1), (True, None, 2)]
    assert {r.n for r in out} == {4}


def test_far_entries(spark):
    rows = [(k, [1e16 * k * k, float(k % 3)]) for k in range(5)]
    out = whitening.whiten(frame(spark, rows)).toPandas()
    assert out.deviation.isna().all() and len(out) >= 5 and np.isfinite(out.whitened).all()


def test_nothing(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
