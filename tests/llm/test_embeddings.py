import numpy as np
import pytest

from caseloom.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, side int, key long"


def brute(rows, cosine=embeddings.COSINE):
    n = len(rows)
    good, unit = [], []
    for i, (_, e, label) in enumerate(rows):
        v = np.array([np.nan if x is None else x for x in (e or [])], float)
        if label is not None and v.size and np.isfinite(v).all() and v.any():
            good.append(i)
            unit.append(v / np.linalg.norm(v))
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, i in enumerate(good):
        for y, j in enumerate(good[:x]):
            if rows[i][2] == rows[j][2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        least[i] = min(ids, default=None)
    return sorted(((rows[i][0] if rows[i][0] is not None else -1, links[i], -1 if least[i] is None else least[i]) for i in range(n)))


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    out = embeddings.near_duplicates(df, **more).collect()
    assert all(r.kept == (r.component_id == r.vec_id) for r in out)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in out)


def cluster_rows(seed, n, width=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    rows = []
    for i in range(n):
        c = centres[rng.integers(12)]
        spread = rng.choice([0.05, 0.2, 0.27, 0.4, 2.0])
        v = (c + spread * rng.standard_normal(width)).astype(np.float32)
        rows.append((i, v.tolist(), int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("chunk", [1024, 7])
def test_against_brute_force(spark, chunk):
    rows = cluster_rows(1, 260)
    want = brute(rows)
    assert sum(w[1] for w in want) > 100
    assert got(spark, rows, chunk=chunk) == want


def test_blocks_let_every_link_through_and_few_others(data):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{data}/sf0.1/embeddings.parquet").to_pandas()
    pairs = passed = linked = 0
    for _, rows in table.groupby("label"):
        raw = np.stack(rows["embedding"]).astype(float)
        place = embeddings.turned(raw)
        some = np.triu(embeddings.let_through(place, place, embeddings.COSINE), 1)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        near = np.triu(unit @ unit.T >= embeddings.COSINE, 1)
        assert not (near & ~some).any()
        pairs, passed, linked = pairs + len(raw) * (len(raw) - 1) // 2, passed + some.sum(), linked + near.sum()
    assert pairs and passed - linked < pairs / 200


def test_edge_cases(spark):
    v = [1.0] + [0.0] * 7
    w = [1.0, 0.3] + [0.0] * 6
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0] + [0.0] * 7, 0), (4, w, 0), (5, v, 1), (6, v, None), (7, None, 0), (8, [0.0] * 8, 0), (9, [float("nan")] + v[1:], 0), (10, [None, *v[1:]], 0), (11, [], 0), (None, w, 0), (12, [float("inf")] + v[1:], 0), (13, [1.0, 0.0], 0), (14, [-0.0, 1.0], 0), (15, [0.0, 1.0], 0), (16, [1e-30] + [0.0] * 7, 0)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    rows = [(i, (base + 0.1 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for i in range(150)]
    assert got(spark, rows, chunk=20) == [(i, 149, 0) for i in range(150)]
