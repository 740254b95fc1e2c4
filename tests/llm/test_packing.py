import json
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import packing as P


def check_plan(counts, capacity):
    recipes = P.plan(counts, capacity)
    used = Counter()
    for parts, n in recipes:
        assert n > 0 and sum(x * k for x, k in parts) <= capacity
        for x, k in parts:
            used[x] += k * n
    assert used == Counter({x: n for x, n in counts.items() if n})
    return sum(n for _, n in recipes)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=20))
def test_plan_uses_every_piece_once(counts):
    n = check_plan(counts, 40)
    total = sum(x * k for x, k in counts.items())
    assert n >= -(-total // 40)
    # best fit never leaves two sequences that are half empty
    assert n <= 2 * (total // 40) + 2


def test_exact_complements_are_found():
    assert check_plan({4000: 10, 96: 10}, 4096) == 10
    assert check_plan({4000: 10, 50: 10, 46: 10}, 4096) == 10
    assert check_plan({4000: 10, 50: 10, 40: 10, 6: 10}, 4096) == 10
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 1500) for _ in range(20_000))
    assert check_plan(counts, 4096) <= -(-sum(x * k for x, k in counts.items()) // 4096) + 1


def test_ids_equal_the_tokenizers():
    encoder = P.Encoder(P.vocabulary_path())
    rng = random.Random(2)
    with open(P.vocabulary_path(), encoding="utf-8") as f:
        vocab = [k.removesuffix("</w>") for k in json.load(f)["model"]["vocab"]]
    texts = ["", " \t\n", "<|endoftext|> hi", "it's we'll don't'll''s", "İstanbul ΣΑΣ ﬁ é ́x 日本語 a\x1cb\x85c\xa0d", "½ x² 3.14 ٣ Ⅷ ẞ", "a" * 3000, "﻿x​y", "A_b__c"]
    texts += ["".join(rng.choices(vocab, k=3)) + " " + "".join(rng.choices("aehinorst'!?.0é ", k=20)) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def check_pack(docs, rows, capacity=P.CAPACITY):
    encoder = P.Encoder(P.vocabulary_path())
    want = []
    for r in docs:
        ids = encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_pack_real_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    n, least = check_pack(docs.collect(), P.pack(docs).collect())
    assert n <= least + 1


def test_edge_cases(nasty, nothing):
    n, least = check_pack(nasty.collect(), P.pack(nasty).collect())
    assert n <= least + 1
    assert P.pack(nothing).count() == 0


def test_real_output_holds_the_ids(nasty):
    rows = P.pack(nasty.where("doc_id = 1"), keep=True).collect()
    assert len(rows) == 3 and all(len(r.ids) == r.length and r.ids[-1] == 1 for r in rows)


def test_small_capacity_and_one_hot_length(spark):
    docs = spark.createDataFrame([(i, "word " * 30) for i in range(200)] + [(1000 + i, "a") for i in range(50)], "doc_id long, text string")
    n, least = check_pack(docs.collect(), P.pack(docs, capacity=64).collect(), 64)
    assert n <= 1.05 * least + 1


def test_pieces_that_are_all_the_same(spark):
    docs = spark.createDataFrame([(None, "the same words")] * 400 + [(i, "others, of many words each") for i in range(50)], "doc_id long, text string")
    cut = P.pieces(docs, capacity=16, keep=False)
    n, least = check_pack(docs.collect(), P.placed(cut, 16, chunk=7).collect(), 16)
    assert n <= 1.3 * least + 1
    assert max(r["__n"] for r in P.chunked(cut, 7).collect()) == 7
