"""Operator 5, quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the ratings in `labels`: 0 for toxic, 1 for low quality, 2 for neither.  One weight
vector over hashed text features is shared by all grades; ordered thresholds cut its score:
P(grade >= k) = sigmoid(score - threshold_k).  The expected grade is the sum of these tails, and the
tail P(grade >= 2) decides: below 1/2 a document is rejected.

Features of a whole text, each present or not: every distinct word (lower case, stripped of marks),
its prefixes of 3 to 7 letters, marks at a token's end, and coarse shares of the text (repetition,
capitals, marks, digits, distinct lines).  They are hashed to PLACES places, each with one weight, so the
model's size is fixed and no feature is left out.

Fitted on a bounded sample: at most `rows` labelled documents, those of least hash of doc_id.  Every
document is scored.

Edge cases: rows of `labels` with both ratings null, or without a document, teach nothing; a doc_id
rated several times has the lowest of its grades, and of several texts under one doc_id the first in
order teaches; without
any usable label every document gets the top grade and stays; null and empty texts have only the
feature "empty"; null and repeated doc_ids are carried through; other columns pass or are ignored.
"""

from __future__ import annotations

import operator
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import blank, durable

ROWS = 8_000
PLACES = 1 << 20
GRADES = 3
EPOCHS = 100
BATCH = 256
RATE = 0.3
SHRINK = 1e-3
CAUTION = 1e-4  # squared slope that every weight starts with
RARE = 8  # documents with a feature at which its weight moves at a quarter of the full rate
REMEMBERED = 1 << 17
PREFIXES = (3, 4, 5, 6, 7)  # letters
MARKS = string.punctuation + "«»„“”‘’¡¿…–—"


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % PLACES


def of_token(token: str) -> list[int]:
    """Features of one white-space token."""
    word = token.strip(MARKS).lower()
    out = [place("w " + word)] if word else []
    out += [place("p " + word[:n]) for n in PREFIXES if n < len(word)]
    tail = token[len(token.rstrip(MARKS)) :]
    if len(tail) > 1 or tail not in ("", ".", ","):
        out.append(place("m " + tail[:4]))
    return out


def of_whole(text: str, tokens: list[str], distinct: set[str]) -> list[int]:
    """Features of the text as a whole: shares in coarse steps."""
    if not tokens:
        return [place("empty")]
    n = len(tokens)
    letters = max(1, sum(map(len, tokens)))
    lines = text.split("\n")
    upper = sum(t.isupper() and len(t) > 1 for t in distinct) / len(distinct)
    bare = sum(not t.strip(MARKS) for t in distinct) / len(distinct)
    digits = sum(map(text.count, string.digits)) / letters
    marks = sum(map(text.count, "!#$%&*|<>{}[]=~^@_")) / letters
    step = lambda x, s: int(min(x, 1.0) * s)
    named = {
        "repeated": step(sum(map(operator.eq, tokens, tokens[1:])) / n, 8),
        "distinct": step(len(distinct) / n * max(1.0, n / 2000) ** 0.5, 10),
        "upper": step(upper, 8),
        "bare": step(bare, 8),
        "digits": step(digits * 4, 8),
        "marks": step(marks * 5, 10),
        "length": int(np.log2(n)),
        "lines": step(len(set(lines)) / len(lines), 8),
        "wordlength": min(int(letters / n), 15),
    }
    return [place(f"{k}={v}") for k, v in named.items()]


def features(text: str) -> np.ndarray:
    tokens = text.split()
    distinct = set(tokens)
    found = set(of_whole(text, tokens, distinct))
    for t in distinct:
        found.update(of_token(t))
    return np.fromiter(found, np.int64, len(found))


class Model:
    """A weight for each place, and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        """The same sum over distinct features that the model was fitted on."""
        tokens = text.split()
        distinct = set(tokens)
        known, seen = self.known, set(of_whole(text, tokens, distinct))
        try:
            seen.update(*map(known.__getitem__, distinct))
        except KeyError:
            for t in distinct:
                got = known.get(t)
                if got is None:
                    got = tuple(of_token(t))
                    if len(known) < REMEMBERED:
                        known[t] = got
                seen.update(got)
        places = np.fromiter(seen, np.int64, len(seen))
        places.sort()  # one order of additions, whatever the order of the set
        return float(self.weights[places].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(starts: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by adaptive gradient steps on the cumulative-link likelihood.

    The means over the later half of the epochs: single steps swing around the optimum.  What is rare
    moves less, or the sample is explained by its rare words and nothing is learned from the common ones.

    Row i has the features columns[starts[i]:starts[i + 1]].  For the logistic link the score's
    gradient at grade k is 1 - P(>= k) - P(>= k + 1), with P(>= 0) = 1 and P(>= GRADES) = 0.
    """
    rng = np.random.default_rng(5)
    weights, seen = np.zeros(width), np.full(width, CAUTION)
    share = [max(1e-3, min(1 - 1e-3, (grades >= k).mean())) for k in range(1, GRADES)]
    thresholds = np.array([-np.log(s / (1 - s)) for s in share])
    thresholds = np.maximum.accumulate(thresholds + np.arange(GRADES - 1) * 1e-3)
    seen_t = np.full(GRADES - 1, 1e-8)
    sizes = np.diff(starts)
    n = np.bincount(columns, minlength=width)
    trust = RATE * (n / (n + RARE)) ** 2
    mean, mean_t, held = np.zeros(width), np.zeros(GRADES - 1), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            n = sizes[rows]
            entry = np.repeat(starts[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cols, owner = columns[entry], np.repeat(np.arange(len(rows)), n)
            score = np.bincount(owner, weights[cols], len(rows))
            p = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -30, 30)))
            p = np.column_stack([np.ones(len(rows)), p, np.zeros(len(rows))])
            y = grades[rows]
            here, above = p[np.arange(len(rows)), y], p[np.arange(len(rows)), y + 1]
            slope = 1 - here - above
            grad = np.flatnonzero(np.bincount(cols, minlength=width))
            step = np.bincount(cols, slope[owner], width)[grad] / len(rows)
            seen[grad] += step**2
            rate = trust[grad] / np.sqrt(seen[grad])
            moved = weights[grad] + rate * step
            weights[grad] = np.sign(moved) * np.maximum(np.abs(moved) - rate * SHRINK, 0)
            mass = np.maximum(here - above, 1e-9)
            turn = np.zeros(GRADES - 1)
            for k in range(1, GRADES):
                bend = p[:, k] * (1 - p[:, k]) / mass
                turn[k - 1] = (np.where(y == k - 1, bend, 0) - np.where(y == k, bend, 0)).mean()
            seen_t += turn**2
            thresholds = thresholds + RATE / np.sqrt(seen_t) * turn
            thresholds = np.maximum.accumulate(thresholds + np.arange(GRADES - 1) * 1e-6)
        if 2 * epoch >= EPOCHS:
            mean, mean_t, held = mean + weights, mean_t + thresholds, held + 1
    return mean / held, mean_t / held


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """__doc, __grade, __text of at most `rows` labelled documents, chosen by hash."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.coalesce("toxic", "quality").isNotNull(), 2)
    graded = labels.select(F.col("doc_id").alias("__doc"), grade.alias("__grade")).where("__doc is not null and __grade is not null")
    graded = graded.groupBy("__doc").agg(F.min("__grade").alias("__grade"))
    texts = docs.select(F.col("doc_id").alias("__id"), blank("text").alias("__text"))
    have = graded.join(texts.select("__id").distinct(), F.col("__doc") == F.col("__id"), "left_semi")
    chosen = have.orderBy(F.xxhash64("__doc"), "__doc").limit(rows)
    met = texts.join(F.broadcast(chosen), F.col("__id") == F.col("__doc"))  # `rows` rows of two numbers
    return met.groupBy("__doc", "__grade").agg(F.min("__text").alias("__text"))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"__doc": pdf["__doc"], "__grade": pdf["__grade"], "ids": [np.sort(features(t)).astype(np.int32) for t in pdf["__text"]]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    featured = durable(sample(docs, labels, rows).mapInPandas(_featured, "__doc long, __grade int, ids array<int>"))
    data = featured.orderBy("__doc").toArrow()  # at most `rows` rows
    if not data.num_rows:
        return Model(np.zeros(PLACES), np.full(GRADES - 1, -40.0))
    ids, grades = data["ids"].combine_chunks(), data["__grade"].to_numpy()
    del data
    starts = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
    flat = ids.flatten().to_numpy()
    met = np.zeros(PLACES, bool)
    met[flat] = True
    places = np.flatnonzero(met)  # the others' weights stay 0
    columns = (np.cumsum(met, dtype=np.int32) - 1)[flat]
    del ids, flat
    found, thresholds = fit_ordinal(starts, columns, grades, len(places))
    weights = np.zeros(PLACES)
    weights[places] = found
    return Model(weights, thresholds)


def scored(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The model's score of each row's text, for use in `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return score(blank(text))


def tail(score: Column, threshold: float) -> Column:
    return 1 / (1 + F.exp(F.lit(float(threshold)) - score))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_acceptable (grade 1 or more), p_good (2), kept; one row per row."""
    rows = docs.select("doc_id", scored(docs, model).alias("score"))
    tails = [tail(F.col("score"), t) for t in model.thresholds]
    return rows.select("doc_id", (tails[0] + tails[1]).alias("expected_grade"), tails[0].alias("p_acceptable"), tails[1].alias("p_good"), (tails[1] >= 0.5).alias("kept"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without the documents that the model rejects; columns as they were."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rated = docs.select(whole, scored(docs, model).alias("score"))
    return rated.where(tail(F.col("score"), model.thresholds[-1]) >= 0.5).select("whole.*")
