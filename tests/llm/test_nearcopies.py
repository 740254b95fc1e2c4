import random
import re

import numpy as np

from caseloom.llm import nearcopies, simhash


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    words = words_of(text)
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(texts):
    """The group of each text: the least place it reaches."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(rng, words, share):
    out = list(words)
    for _ in range(round(share * len(out))):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed, n=240):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 40, 200, 400]))] for _ in range(40)]
    texts = []
    for _ in range(n):
        texts.append(" ".join(edited(rng, rng.choice(bases), rng.choice([0, 0.004, 0.01, 0.02, 0.04, 0.1]))))
    return texts


def test_wide_counters_against_bit_counts():
    rng = np.random.default_rng(4)
    members = rng.integers(0, 1 << 63, (6, 64, 4), dtype=np.uint64)
    queries = members[:, 5].copy()
    for k in range(0, 6):
        for b in rng.choice(256, 12 * k + 3, replace=False):
            queries[k, b // 64] ^= np.uint64(1 << int(b % 64))
    lanes = np.full(6, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for radius in (7, 31, 71, 127):
        item, hit = simhash.near_wide(queries, np.arange(6), simhash.vertical(members), lanes, radius)
        got = {int(i): int(h) for i, h in zip(item, hit, strict=True) if h}
        far = np.unpackbits((members ^ queries[:, None]).view(np.uint8), axis=2).sum(axis=2)
        want = {i: sum(1 << k for k in range(64) if far[i, k] <= radius) for i in range(6)}
        assert got == {i: h for i, h in want.items() if h}


def test_groups_against_brute_force(spark):
    for seed, chunk in ((1, 512), (2, 16)):
        texts = corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        want = {i for i, g in enumerate(brute(texts)) if g == i}
        assert 20 < len(want) < len(texts)
        assert {r.doc_id for r in nearcopies.one_per_group(docs, chunk).collect()} == want


def test_hot_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(edited(rng, base, 0.004)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in nearcopies.one_per_group(docs, 20).collect()] == sorted(set(brute(texts)))


def test_one_row_of_each_group_whatever_its_id(spark, nasty, nothing):
    words = [f"{w}{k}" for k in range(40) for w in ("alpha", "beta", "gamma")]
    x, y, u, v, w = (" ".join(random.Random(k).sample(words, 60)) for k in range(5))
    rows = [(3, x, "a", 1), (7, x, "a", 1), (7, y, "a", 1), (7, y, "b", 1), (7, y, "b", 1), (None, u, "a", 1), (None, u, "b", 1), (None, v, "a", 1), (None, x, "a", 1), (9, w, None, 1), (None, w, "a", 1)]
    for k in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, row string, __kept int").repartition(k)
        kept = nearcopies.one_per_group(docs)
        assert kept.columns == docs.columns
        got = [tuple(r) for r in kept.collect()]
        assert sorted((r[:2] for r in got), key=repr) == sorted([(3, x), (7, y), (None, u), (None, v), (9, w)], key=repr)
        first = got if k == 1 else first
        assert sorted(got, key=repr) == sorted(first, key=repr)
    kept = nearcopies.one_per_group(nasty)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6, 7, 9] and kept.columns == nasty.columns
    assert nearcopies.one_per_group(nothing).count() == 0


def test_real_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {rows[g].doc_id for g in brute([r.text for r in rows])}
    assert {r.doc_id for r in nearcopies.one_per_group(docs).collect()} == want


def test_pipeline_keeps_every_group(spark):
    import corpus_pipeline

    texts = [" ".join(random.Random(k).choices("abcdefghij", k=50)) for k in range(6)]
    docs = spark.createDataFrame([(None if k < 4 else 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.text for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()) == sorted(texts)
