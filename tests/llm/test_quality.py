import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import quality


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    width, n = 40, 3000
    true = rng.normal(0, 1.5, width)
    rows = [np.flatnonzero(rng.random(width) < 0.3) for _ in range(n)]
    score = np.array([true[r].sum() for r in rows]) + rng.logistic(size=n)
    grades = np.digitize(score, [-1.0, 1.0])
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    weights, thresholds = quality.fit_ordinal(starts, np.concatenate(rows), grades, width)
    assert thresholds[0] < thresholds[1]
    assert np.corrcoef(weights, true)[0, 1] > 0.95


@pytest.fixture(scope="module")
def held_out(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{data}/sf0.1/labels.parquet").dropDuplicates(["doc_id"])
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality.fit(docs, labels.where(half == 0))
    return quality.grade(docs, model).join(labels.where(half == 1), "doc_id").toPandas()


def test_held_out_accuracy(held_out):
    toxic, low = held_out[held_out.toxic == 1], held_out[(held_out.toxic == 0) & (held_out.quality == 0)]
    clean = held_out[(held_out.toxic == 0) & (held_out.quality == 1)]
    assert clean.kept.mean() > 0.99
    assert (~toxic.kept).mean() > 0.97
    assert (~low.kept).mean() > 0.85
    assert toxic.expected_grade.mean() < low.expected_grade.mean() < clean.expected_grade.mean()


def test_edge_cases(spark, nasty, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (2, 0, 0), (3, None, 1), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(nasty, labels)
    out = quality.grade(nasty, model).collect()
    assert len(out) == 11 and all(0 <= r.p_good <= r.p_acceptable <= 1 for r in out)
    assert quality.grade(nothing, model).count() == 0
    unlabelled = quality.fit(nasty, labels.limit(0))
    assert quality.keep_good(nasty, unlabelled).count() == 11
    assert quality.keep_good(nasty, unlabelled).columns == nasty.columns
    assert not quality.fit(nothing, labels).weights.any()


def test_whole_texts_count(spark):
    weights = np.zeros(quality.PLACES)
    weights[quality.place("w scum")] = -50.0
    model = quality.Model(weights, np.array([-2.0, -1.0]))
    long = "fine words here " * 200_000
    docs = spark.createDataFrame([(1, long), (2, long + " Scum!")], "doc_id long, text string")
    assert [r.kept for r in quality.grade(docs, model).orderBy("doc_id").collect()] == [True, False]


def by_hand(text, model):
    """The score from every feature's own definition."""
    tokens = text.split()
    names = {quality.place("empty")} if not tokens else set(quality.of_whole(text, tokens, set(tokens)))
    for t in tokens:
        word, end = t.strip(quality.MARKS).lower(), t[len(t.rstrip(quality.MARKS)) :]
        names |= {quality.place("w " + word)} if word else set()
        names |= {quality.place("p " + word[:n]) for n in range(3, 8) if n < len(word)}
        names |= {quality.place("m " + end[:4])} if end not in ("", ".", ",") else set()
    return sum(model.weights[p] for p in names)


def test_query_against_brute_force(spark, data, nasty):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    labels = spark.read.parquet(f"{data}/sf0.001/labels.parquet")
    model = quality.fit(docs, labels)
    for table in (docs, nasty.where("length(text) < 1000 or text is null")):
        want = []
        for r in table.collect():
            p = [1 / (1 + np.exp(t - by_hand(r.text or "", model))) for t in model.thresholds]
            want.append((r.doc_id or 0, round(sum(p), 6), round(p[0], 6), round(p[1], 6), bool(p[1] >= 0.5)))
        got = [(r.doc_id or 0, round(r.expected_grade, 6), round(r.p_acceptable, 6), round(r.p_good, 6), r.kept) for r in quality.grade(table, model).collect()]
        assert sorted(got) == sorted(want)


def test_the_same_model_in_any_partitioning(spark):
    rows = [(k % 5, f"word{k} text{k % 3}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(5)], "doc_id long, quality int, toxic int")
    one, two = (quality.fit(spark.createDataFrame(rows[::d], "doc_id long, text string").repartition(n), labels) for d, n in ((1, 1), (-1, 4)))
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()


def test_clashing_names_pass(spark):
    docs = spark.createDataFrame([(1, "a", 2.5, 7)], "doc_id long, text string, score double, __score int")
    model = quality.Model(np.zeros(quality.PLACES), np.full(2, -40.0))
    assert [tuple(r) for r in quality.keep_good(docs, model).collect()] == [(1, "a", 2.5, 7)]
