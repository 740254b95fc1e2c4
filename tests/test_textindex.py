"""The index against BM25 by definition."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import textindex


def by_hand(docs, asked, most, least):
    texts = {}
    for doc, text in docs:
        if doc is not None:
            texts[doc] = min(texts.get(doc, text or ""), text or "")
    split = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in texts.items()}
    n, mean = len(split), sum(map(len, split.values())) / max(1, len(split))
    df = Counter(w for ws in split.values() for w in set(ws))
    out = []
    for q, term in asked:
        scores = []
        for d, ws in split.items():
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(re.findall(r"[^\W_]+", (term or "").lower())) if tf[w])
            scores.append((-round(s, 6), d))
        out += [(q, k, d, -s) for k, (s, d) in enumerate(sorted(x for x in scores if -x[0] > least)[:most], 1)]
    return out


def got(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_search_equals_the_definition(spark, tmp_path):
    rng = random.Random(3)
    common, rare = ["the", "of", "and", "a"], [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(1, 60)))) for k in range(400)]
    docs += [(400 + k, docs[k][1]) for k in range(40)] + [(None, "w1 w2"), (7, "~ of several texts the first stays"), (900, None), (901, "")]
    asked = [(k, docs[k * 9][1]) for k in range(40)] + [(50, "the of and a"), (51, "w1"), (52, None), (53, "unknown"), (54, "The THE w7, w8!")]
    path = f"{tmp_path}/index"
    textindex.add(spark.createDataFrame(docs[:200], "doc long, text string"), path)
    textindex.add(spark.createDataFrame(docs, "doc long, text string"), path)  # what is known is passed over
    questions = spark.createDataFrame(asked, "query_id int, term string")
    for most in (1, 5, 20):
        assert got(textindex.search(questions, path, most)) == by_hand(docs, asked, most, 0.3)
    assert got(textindex.search(questions, path, 1000, 0.0)) == by_hand(docs, asked, 1000, 0.0)


def test_equal_scores_rank_by_id(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc"), F.concat(F.lit("the of and "), F.repeat(F.concat(F.lit("x"), (F.col("id") % 100).cast("string"), F.lit(" ")), 3), F.lit("y "), F.col("id").cast("string")).alias("text"))
    textindex.add(docs, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "the of and y x7")], "query_id int, term string")
    found = textindex.search(asked, f"{tmp_path}/index", 5)
    assert [r.doc for r in found.orderBy("rank").collect()] == [7, 107, 207, 307, 407]


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc long, text string")
    textindex.add(empty, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "a")], "query_id int, term string")
    assert textindex.search(asked, f"{tmp_path}/index").count() == 0
    textindex.add(spark.createDataFrame([(1, "b a"), (2, "c"), (3, "d")], "doc long, text string"), f"{tmp_path}/index")
    assert [r.doc for r in textindex.search(asked, f"{tmp_path}/index", least=0.1).collect()] == [1]
    assert textindex.search(asked.limit(0), f"{tmp_path}/index").count() == 0


def test_no_pair_of_question_and_document_is_sent(spark, tmp_path, monkeypatch):
    """Many blocks, questions that meet every document, and groups of equal texts larger than the answers asked for."""
    monkeypatch.setattr(textindex, "BLOCK", 64)
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choices(["the", "of", "a", *(f"w{i}" for i in range(30))], k=12)) if k % 3 else "the same text of w1") for k in range(600)]
    textindex.add(spark.createDataFrame(docs, "doc long, text string"), f"{tmp_path}/index")
    asked = [(f"q{k}", docs[k * 7][1]) for k in range(30)]
    found = textindex.search(spark.createDataFrame(asked, "query_id string, term string"), f"{tmp_path}/index", 10, 0.0)
    assert got(found) == sorted(by_hand(docs, asked, 10, 0.0))
    assert "sum(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_sent_to_python_hold_no_list_and_blocks_share_no_task(spark, tmp_path, monkeypatch):
    """With a list among the columns a row sent to Python took many times as long."""
    monkeypatch.setattr(textindex, "BLOCK", 64)
    textindex.add(spark.createDataFrame([(k, f"a b{k % 7} c{k}") for k in range(600)], "doc long, text string"), f"{tmp_path}/index")
    found = textindex.search(spark.createDataFrame([(1, "a b1 c5")], "query_id int, term string"), f"{tmp_path}/index", 3)
    node = found._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    assert "array" not in node.children().head().schema().catalogString()
    while node.nodeName() != "RepartitionByExpression":
        node = node.children().head()
    assert "partition_id(block" in node.simpleString(100)


def test_a_block_of_frequent_and_rare_words(monkeypatch):
    monkeypatch.setattr(textindex, "OFTEN", 5)
    monkeypatch.setattr(textindex, "DENSE", 3)
    rng = random.Random(6)
    posts = [(w, d * 10, rng.random()) for w in range(40) for d in range(90) if rng.random() < (0.5 if w % 8 == 0 else 0.1)]
    posts += [(w, 905, x) for w, d, x in posts if d == 300]  # a copy, of equal score
    block = textindex._Block(*(np.array(c) for c in zip(*posts, strict=True)))
    assert len(block.matrix) == 3
    asked = [rng.sample(range(-2, 45), 12) for _ in range(20)] + [[], [77]]
    for words, (docs, scores) in zip(asked, block.best([np.array(a, np.int32) for a in asked], 7, 0.2), strict=True):
        total = Counter()
        for w, d, x in posts:
            total[d] += x * (w in words)
        want = sorted((-round(x, 6), d) for d, x in total.items() if round(x, 6) > 0.2)[:7]
        assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)] == want
