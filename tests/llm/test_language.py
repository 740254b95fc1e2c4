import zlib

import numpy as np
import pytest

from caseloom.llm import language


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == truth[r.doc_id].lang for r in held if any(c.isalpha() for c in truth[r.doc_id].text)]
    assert len(right) > 150 and np.mean(right) > 0.97


def test_prediction_ignores_everything_but_text(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    langs, table = language.train(language.fold(docs).where("__fold <> 2"))
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, langs, table).collect()}
    other = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs.selectExpr("doc_id", "text", "'xx' as lang", "null as source"), langs, table).collect()}
    assert one == other


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "Äpfel und Birnen, 12 Stück! " * 50
    whole = language.grams(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(language, "SLICE", size)
        assert (language.grams(text) == whole).all()
    n = len("".join(" " + w for w in "äpfel und birnen stück".split())) * 50 + 1
    assert abs(int(whole.sum()) - 3 * n) <= 8


def test_multinomial_scores():
    table = np.log(np.array([[0.7, 0.2], [0.3, 0.8]]))
    counts = language.grams("abc", 2)
    logs = counts @ table
    best = int(np.argmax(logs))
    lang, score = language.score("abc", ["x", "y"], table)
    assert lang == "xy"[best]
    assert score == pytest.approx(1 / np.exp((logs - logs[best]) / np.sqrt(counts.sum())).sum())


def test_edge_cases(nasty, nothing):
    rows = language.identify(nasty).collect()
    assert len(rows) == 11
    texts = [(r.doc_id, r.text) for r in nasty.collect()]
    want_und = sum(t is None or not any(c.isalpha() for c in t) for _, t in texts)
    und = [r for r in rows if r.lang_pred == "und"]
    assert len(und) == want_und and all(r.score == 0 for r in und)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(nasty.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_every_length_around_a_slice(monkeypatch):
    whole = {n: language.grams("abcde" * 6 + "x" * n) for n in range(40)}
    monkeypatch.setattr(language, "SLICE", 16)
    assert all((language.grams("abcde" * 6 + "x" * n) == want).all() for n, want in whole.items())
    monkeypatch.undo()
    for n in range(2**20 - 2, 2**20 + 3):
        assert language.grams("a" * n).sum() == 3 * (n + 1) - 3


def test_no_language_is_left_out(spark, monkeypatch):
    rows = [(k, "zebra zigzag zones", "zz") for k in range(8)] + [(100 + k, "".join(chr(97 + k // 26**j % 26) for j in range(3)) * 3, f"a{k:04d}") for k in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert {got[k][0] for k in range(8)} == {"zz"}
    some = docs.where("doc_id < 140")
    want = {r.doc_id: r for r in language.identify(some).collect()}
    monkeypatch.setattr(language, "LANGS", 7)
    for r in language.identify(some).collect():
        assert r.score == pytest.approx(want[r.doc_id].score)
        # sums in another order may break a tie otherwise
        assert r.lang_pred == want[r.doc_id].lang_pred or r.score < 0.5


def grams_by_hand(text, buckets=language.BUCKETS):
    """Hashed n-grams one by one, in whole numbers."""
    mask, plain = (1 << 64) - 1, []
    for c in text.lower():
        if c.isalpha():
            plain.append(c)
        elif plain and plain[-1] != " ":
            plain.append(" ")
    points = [32, *map(ord, plain)]
    found = {}
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = n
            for p in points[i : i + n]:
                h = ((h * 0x100000001B3) & mask) ^ p
            h ^= h >> 29
            h = (h * 0xBF58476D1CE4E5B9) & mask
            found[(h >> 40) % buckets] = found.get((h >> 40) % buckets, 0) + 1
    return found


def test_query_against_brute_force(spark, data):
    """Naive Bayes by its definition, over every row."""
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    rows = docs.collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None and any(map(str.isalpha, r.text)):
            own = counts.setdefault(r.lang, {})
            for b, n in grams_by_hand(r.text).items():
                own[b] = own.get(b, 0) + n
    total = {lang: sum(c.values()) + language.SMOOTHING * language.BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for r in rows:
        grams = grams_by_hand(r.text or "") if any(map(str.isalpha, r.text or "")) else {}
        if not grams:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        logs = {lang: sum(n * np.log((c.get(b, 0) + language.SMOOTHING) / total[lang]) for b, n in grams.items()) for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        root = np.sqrt(sum(grams.values()))
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp((v - logs[best]) / root) for v in logs.values()), rel=1e-6)
