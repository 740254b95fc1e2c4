"""Symptoms in a taxonomy's words, against every pair."""

import random

from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import linkage, symptoms


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def test_prefixes_lose_no_label(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + k)}" for k in range(14)]
    make = lambda: " ".join(sorted(set(rng.choices(words, k=rng.randrange(1, 9)))))
    labels = sorted({make() for _ in range(40)})
    rng.shuffle(labels)
    texts = sorted({make() for _ in range(300)})
    for least in (0.45, 0.8):
        want = {}
        for t in texts:
            score, place = max((jaccard(t, label), -k) for k, label in enumerate(labels))
            if score >= least:
                want[t] = (labels[-place], round(score, 9))
        got = symptoms.similar_labels(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(v, k) for k, v in enumerate(labels)], "label string, place int"), least)
        assert {r.text: (r.label, round(r.score, 9)) for r in got.collect()} == want and len(want) > 10


def test_canonical_symptoms(spark):
    taxonomy = spark.createDataFrame([("noStart", "Engine does not start", 1), ("roughIdle", "Rough idle", 2), ("idleRough", "Idle rough", 3), ("leak", "Oil leak", 4)], "key string, label string, place int")
    rows = [
        (1, ["NOSTART", " Engine does not start! ", "idle ROUGH", "a tail that no label has", ""]),
        (2, ["Öil leak", "leak of oil", "oil", None]),
        (3, None),
        (4, []),
        (5, ["leak", "Leak"]),
    ]
    got = {r.id: r.symptoms for r in symptoms.canonical_symptoms(spark.createDataFrame(rows, "id int, symptoms array<string>"), taxonomy).collect()}
    assert got == {1: ["Engine does not start", "Rough idle", "a tail that no label has"], 2: ["Oil leak"], 3: [], 4: [], 5: ["Oil leak"]}


def test_words_that_no_label_has_do_not_travel(spark):
    rows = spark.createDataFrame([("a", ["wa", "wb", "x1"]), ("b", ["wa", "x1", "x2", "x3"]), ("c", ["x1"])], "text string, words array<string>")
    ranks = spark.createDataFrame([("wa", 3), ("wb", 1)], "word string, labels long")
    got = {(r.text, r.n, tuple(r.known), r.at, r.w) for r in symptoms._keyed(rows, ranks, ["text"], 0.45).collect()}
    assert got == {("a", 3, ("wb", "wa"), 0, "wb")}


def test_texts_are_sent_once_and_joined_with_nothing(spark):
    cases = spark.createDataFrame([(k, [f"K{k % 3}", f"oil leak of {k}", str(k)]) for k in range(12)], "id int, symptoms array<string>")
    taxonomy = spark.createDataFrame([(f"k{k}", f"leak of oil {'abc'[k]}", k) for k in range(3)], "key string, label string, place int")
    found = symptoms.canonical_symptoms(cases, taxonomy)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # a label's words and how many labels have them
    got = {r.id: r.symptoms for r in found.collect()}
    assert got == {k: list(dict.fromkeys([f"leak of oil {'abc'[k % 3]}", "leak of oil a", str(k)])) for k in range(12)}


def test_texts_have_the_words_that_labels_have(spark):
    odd = ["", " ", "Öl 20TDI tdi20 a1b2 1.4-TSI", "ﬁlter №5 ½", "x1x 12 12ab", "K\u0307 İstanbul ẞ", "🚗 motor", "A\tb\nC"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", linkage.overlap_tokens(T.fold_words(F.col("text"))).alias("words")).collect()
    assert {r.text: set(r.words) for r in rows} == {t: symptoms._tokens(t) for t in odd}


def test_few_pairs_at_once_lose_none(monkeypatch):
    monkeypatch.setattr(symptoms, "PAIRS", 5)
    rng = random.Random(9)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    sets = [sorted(set(rng.choices(words, k=rng.randrange(1, 14)))) for _ in range(80)]
    count = {w: sum(w in s for s in sets) for w in words}
    labels = [(f"l{k}", sorted(s, key=lambda w: (count[w], w))) for k, s in enumerate(sets)]
    texts = sorted({" ".join(rng.choices([*words, "unknown", "other"], k=rng.randrange(1, 16))) for _ in range(300)} | {""})
    for least in (0.45, 0.5, 1.0):
        want = {}
        for t in texts:
            score, place = max((jaccard(t, " ".join(s)), -k) for k, s in enumerate(sets))
            if score >= least:
                want[t] = (f"l{-place}", score)
        assert symptoms._Labels(labels, least).best(texts) == want and len(want) > 3
    assert symptoms._Labels([], 0.45).best(texts) == {}
