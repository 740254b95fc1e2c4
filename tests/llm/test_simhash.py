import random
import re

import numpy as np
import pytest
import xxhash

from caseloom.llm import simhash


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [min((ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None), default=None) for i in range(len(ids))]


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choices("abC É\t\n\x0bx ß ", k=rng.randint(0, 60)))
        assert simhash.fingerprint(t) == by_definition(t)
    assert simhash.fingerprint("") == 0


@pytest.mark.parametrize(("blocks", "chunk"), [(4, 1024), (4, 8), (5, 16), (6, 1024)])
def test_groups_against_brute_force(spark, blocks, chunk):
    rng = random.Random(blocks * 100 + chunk)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5])):
            p ^= 1 << b
        prints.append(p)
    ids = list(range(len(prints)))
    df = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in zip(ids, prints, strict=True)], "doc_id long, fp long")
    by_print = {r.fp: r.component_id for r in simhash.groups(df, blocks=blocks, chunk=chunk).collect()}
    assert [by_print[int(np.uint64(p).astype(np.int64))] for p in prints] == brute(ids, prints)


def test_near_counts_every_lane():
    rng = np.random.default_rng(3)
    members = rng.integers(0, 1 << 63, (5, 64), dtype=np.uint64)
    queries = members[:, 0].copy()
    for b in (1, 9, 33):
        queries[1:] ^= np.uint64(1 << b)
    members[:, 7] = queries ^ np.uint64(1 << 60)
    full = np.full(5, 0xFFFFFFFFFFFFFFFF, np.uint64)
    item, hits = simhash.near(queries[:, None], np.arange(5), simhash.vertical(members[:, :, None]), full)
    for i, h in zip(item, hits, strict=True):
        want = sum(1 << k for k in range(64) if (int(queries[i]) ^ int(members[i, k])).bit_count() <= 3)
        assert int(h) == want
    assert set(item) == set(range(5))


def test_real_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    rows = docs.collect()
    prints = [by_definition(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(prints, brute([r.doc_id for r in rows], prints), strict=True), strict=True))
    for r in simhash.near_duplicates(docs).collect():
        assert (int(r.fingerprint, 16), r.component_id) == want[r.doc_id]


def test_edge_cases(nasty, nothing):
    rows = nasty.collect()
    out = simhash.near_duplicates(nasty).collect()
    prints = [by_definition(r.text) for r in rows]
    want = brute([r.doc_id for r in rows], prints)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=key) == sorted(((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)), key=key)
    assert simhash.near_duplicates(nothing).count() == 0
