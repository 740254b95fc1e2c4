import random
import time
import zlib

import numpy as np
import pytest

from caseloom.llm import toxicity
from caseloom.llm.toxicity import Lexicon

ENTRIES = ["idiot", "worthless", "scum", "clown", "réeux*", "vequmo*", "trash", "trashcan"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_hand(word, entries=ENTRIES):
    best = None
    for e, entry in enumerate(entries):
        beginning, bare = entry.endswith("*"), entry.rstrip("*")
        d = min(distance(word[:n], bare) for n in range(len(word) + 1)) if beginning else distance(word, bare)
        if d <= toxicity.errors_allowed(bare, beginning) and (best is None or (d, e) < best):
            best = (d, e)
    return best


def test_automaton_equals_edit_distance():
    rng, lexicon = random.Random(7), Lexicon(ENTRIES)
    words = ["", "a", "idiot", "idot", "iddiot", "1diot", "worthles", "wrothless", "wothles", "réeuxment", "réeaxment", "vequma", "vequm", "clwn", "crown", "trashcan", "trashca", "rashcn"]
    for entry in ENTRIES:
        for _ in range(400):
            w = list(entry.rstrip("*") + rng.choice(["", "", "en", "ment", "s"]))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                w[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice("abcdeilmnoqrstuvé")]
            words.append("".join(w))
    assert [lexicon.nearest(w) for w in words] == [by_hand(w) for w in words]
    assert sum(lexicon.nearest(w) is not None for w in words) > 1000
    assert Lexicon([]).nearest("idiot") is None


def test_long_tokens_cost_no_more_than_their_beginning():
    lexicon = Lexicon(ENTRIES)
    tail = "".join(chr(0x4E00 + k % 5000) for k in range(3_000_000))
    for head, found in (("réeux", (0, 4)), ("réeax", None), ("vequma", (1, 5)), ("trashcan", None), ("idiot", None)):
        assert by_hand(head + tail[:30]) == found
        began = time.process_time()
        assert lexicon.look(head + tail) == lexicon.look(head + tail[:30]) == found
        assert time.process_time() - began < 10
    assert all(len(t) <= toxicity.SHORT for t in lexicon.known) and lexicon.known["idiot" + tail[:30]] is None


def test_signs_and_drawn_out_letters():
    lexicon = Lexicon(ENTRIES)
    for token, errors in (("IDIOT!!", 0), ('"idiot,"', 0), ("1d10t", 1), ("idiiiiiot", 1), ("$cum", 1), ("w0rthl3$$", 1), ("id*ot", 1)):
        assert lexicon.look(token) == (errors, by_hand(token.lower().strip('!",')) [1] if token == "IDIOT!!" else lexicon.look(token)[1]), token
    assert lexicon.look("12345") is None and lexicon.look("...") is None


def test_quotation_and_abuse_are_told_apart():
    def odds(text, at=None):
        tokens = text.split()
        at = next(i for i, t in enumerate(tokens) if "idiot" in t) if at is None else at
        return toxicity.quotation(tokens, at, {i for i, t in enumerate(tokens) if "idiot" in t})

    assert odds('He said the word "idiot" is an insult') > 0.8
    assert odds("Sie schrieb, das Wort «idiot» sei ein Zitat") > 0.8
    assert odds("you are an idiot!") < 0.05
    assert odds('"you absolute idiot, I hate you" idiot idiot') < odds('they called him an "idiot" once')
    assert odds("an idiot stood there") < 0.2
    lexicon, weights = Lexicon(["idiot"]), np.array([[7.0, 6.0, 5.0]])
    model = toxicity.Model(lexicon, weights, np.array([1.0, 0.1, 0.0, 0.5, 0.0]), -5.0)
    assert model.score('the report said the word "idiot" is an insult')[0] < 0.5 < model.score("you idiot")[0]


def test_whole_texts_count():
    model = toxicity.Model(Lexicon(["scum"]), np.array([[7.0, 0, 0]]), np.array([1.0, 0, 0, 0, 0]), -3.0)
    long = "fine words here " * 200_000
    assert model.score(long)[0] < 0.1 and model.score(long + "scum")[0] > 0.7


@pytest.fixture(scope="module")
def tables(spark, data):
    return spark.read.parquet(f"{data}/sf0.1/documents.parquet"), spark.read.parquet(f"{data}/sf0.1/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = toxicity.detect(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    met = out.merge(labels.toPandas().drop_duplicates("doc_id"), on="doc_id")
    held = met[met.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.9
    assert 1 - held[held.toxic == 0].predicted.mean() > 0.99


def test_held_out_labels_are_not_learned_from(spark):
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'good'} word{k % 7}") for k in range(60)], "doc_id long, text string")
    rows = [(k, k % 2) for k in range(60)]
    turned = [(k, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, t in rows]
    one, two = (toxicity.detect(docs.repartition(n), spark.createDataFrame(r, "doc_id long, toxic int")).orderBy("doc_id").collect() for r, n in ((rows, 1), (turned, 5)))
    assert one == two and any(r.predicted for r in one)


def test_query_against_brute_force(spark, data, nasty):
    docs, labels = (spark.read.parquet(f"{data}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    bare = [e.rstrip("*") for e in model.lexicon.entries]
    assert bare
    for table in (docs.where("doc_id < 60"), nasty.where("length(text) < 1000 or text is null")):
        for r, got in zip(table.orderBy("doc_id", "text").collect(), toxicity.predict(table.orderBy("doc_id", "text"), model).collect(), strict=True):
            tokens = (r.text or "").split()
            words = [t.strip(toxicity.MARKS).lower() for t in tokens]
            hits = [by_hand(w, model.lexicon.entries) for w in words]
            if any(h is None and not w.isalpha() for h, w in zip(hits, words, strict=True)):
                assert got.n_terms >= sum(h is not None for h in hits)  # signs for letters may add some
                continue
            terms = {i for i, h in enumerate(hits) if h}
            found = {}
            for i in sorted(terms):
                d, e = hits[i]
                n, kept = found.get((e, d), (0, 0.0))
                found[e, d] = (n + 1, kept + 1 - toxicity.QUOTED * toxicity.quotation(tokens, i, terms))
            z = model.bias + float(np.dot(model.slope, toxicity.evidence(len(tokens), found, model.weights)))
            assert got.score == pytest.approx(1 / (1 + np.exp(-z))) and got.n_terms == len(terms)


def test_edge_cases(spark, nasty, nothing):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (77, 1), (5, 9), (6, 0), (8, 0)], "doc_id long, toxic int")
    out = toxicity.detect(nasty, labels).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 for r in out) and not any(r.held_out for r in out if r.doc_id is None)
    empty = {round(r.score, 12) for r in out if r.doc_id in (2, 3, 5)}
    assert len(empty) == 1
    assert toxicity.detect(nothing, labels).count() == 0
    assert {r.score for r in toxicity.detect(nasty, labels.limit(0)).collect()} <= {toxicity.Model(Lexicon([]), np.zeros((0, 3)), np.zeros(0), -500.0).score("")[0]}


def test_without_terms_length_alone_is_seen_alike(spark):
    docs = spark.createDataFrame([(k, "plain words " * (1 + k % 3)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert not model.lexicon.entries and len(model.slope) == toxicity.FEATURES
    z = model.bias + float(np.dot(model.slope, toxicity.evidence(4, {}, model.weights)))
    assert model.score("plain words plain words")[0] == pytest.approx(1 / (1 + np.exp(-z)))
