"""Operator 9, language identification: multinomial naive Bayes over hashed character n-grams.

Counting covers every training row: each task adds its rows' n-gram counts to one dense vector per
language, Spark sums those by (language, bucket), and the model, a matrix of log probabilities of
`buckets` by languages, is all that reaches the driver.  It is broadcast and applied to batches in
numpy: per text a sparse count vector times the matrix.  Every language takes part: beyond LANGS of
them the counts stay a durable table, and the texts meet one matrix of LANGS languages after another.

No language is likelier than another before its text is seen: there is no class prior, so a language with few training
rows is not held back.

The training rows are those whose crc32(doc_id as text) mod 4 is not 2, with text and lang not null;
lang, source and doc_id never enter a prediction.

Edge cases: a null text, or one without a letter, is `und` with score 0; if nothing can be learned
(no labelled row, an empty table) every row is `und`; a null doc_id counts as the text "null" does
not: its remainder is null, it is not held out and not trained on; repeated rows are predicted
alike, ties go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
LANGS = 256  # columns of a matrix, which bounds memory for very many languages
UNKNOWN = "und"
SLICE = 1 << 20  # characters hashed at a time, which bounds memory for very long texts


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _points(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return points[keep] if letter.any() else points[:0]


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed n-grams of all orders in the whole text; empty if there is no letter."""
    points = _points(text)
    counts = np.zeros(buckets, np.int64)
    if not points.size:
        return counts[:0]
    points = np.concatenate(([np.uint32(32)], points)).astype(np.uint64)
    for at in range(0, points.size, SLICE):
        part = points[at : at + SLICE + max(ORDERS) - 1]
        for n in ORDERS:
            stop = min(SLICE, part.size - n + 1)  # those that start in this slice
            if stop <= 0:
                continue
            mixed = np.full(stop, np.uint64(n))
            for k in range(n):
                mixed = (mixed * np.uint64(0x100000001B3)) ^ part[k : k + stop]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return counts


def _count(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            got = grams(text, buckets)
            if got.size:
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                sums[lang] += got
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


def fold(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("__fold"))


def counted(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket and n, the n-gram counts of all rows with lang and text."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInPandas(lambda it: _count(it, buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _matrix(sums: DataFrame, buckets: int) -> tuple[list[str], np.ndarray]:
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).orderBy("lang").collect()
    table = np.full((buckets, len(packed)), SMOOTHING)
    for k, row in enumerate(packed):
        for bucket, n in row["c"]:
            table[bucket, k] += n
    return [r["lang"] for r in packed], np.log(table / table.sum(axis=0))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities by bucket and language) from rows with lang, text."""
    return _matrix(counted(labelled, buckets), buckets)


def score(text: str | None, langs: list[str], table: np.ndarray) -> tuple[str, float]:
    """(language, posterior of the mean n-gram log odds raised by the root of their number)."""
    counts = grams(text, len(table)) if text is not None and langs else np.zeros(0)
    if not counts.size:
        return UNKNOWN, 0.0
    at = np.flatnonzero(counts)
    logs = counts[at] @ table[at]
    best = int(np.argmax(logs))
    odds = (logs - logs[best]) / np.sqrt(counts.sum())  # n-grams overlap: they aren't so many witnesses
    return langs[best], float(1 / np.exp(odds).sum())


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its text alone."""
    model = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches):
        langs, table = model.value
        for pdf in batches:
            got = [score(t, langs, table) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    rows = fold(docs).select("doc_id", F.coalesce(F.col("__fold") == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _better(batches: Iterator[pd.DataFrame], langs: list[str], table: np.ndarray) -> Iterator[pd.DataFrame]:
    """Best language, its log odds and the sum of all posteriors over its own, with `langs` added."""
    for pdf in batches:
        found = []
        for text, held, best, mass in zip(pdf["text"], pdf["lang_pred"], pdf["best"], pdf["mass"], strict=True):
            counts = grams(text, len(table)) if text is not None else np.zeros(0)
            if not counts.size:
                found.append((UNKNOWN, 0.0, 0.0))
                continue
            at = np.flatnonzero(counts)
            logs = (counts[at] @ table[at]) / np.sqrt(counts.sum())
            k = int(np.argmax(logs))
            top = logs[k] if held is None else max(best, logs[k])
            own = 0.0 if held is None else mass * np.exp(best - top)
            found.append((langs[k] if held is None or logs[k] > best else held, float(top), float(own + np.exp(logs - top).sum())))
        yield pdf.assign(lang_pred=[f[0] for f in found], best=[f[1] for f in found], mass=[f[2] for f in found])


def predict_in_blocks(docs: DataFrame, sums: DataFrame, langs: list[str], buckets: int = BUCKETS) -> DataFrame:
    """What `predict` gives, with a matrix of at most LANGS languages in memory at a time."""
    schema = "doc_id long, held_out boolean, text string, lang_pred string, best double, mass double"
    held = F.coalesce(F.col("__fold") == 2, F.lit(False)).alias("held_out")
    state = fold(docs).select("doc_id", held, "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("best"), F.lit(0.0).alias("mass"))
    for k in range(0, len(langs), LANGS):
        some = langs[k : k + LANGS]
        model = docs.sparkSession.sparkContext.broadcast(_matrix(sums.where(F.col("lang").between(some[0], some[-1])), buckets))
        state = durable(state.mapInPandas(lambda it, model=model: _better(it, *model.value), schema))
        model.unpersist()
    return state.select("doc_id", "held_out", "lang_pred", F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    sums = durable(counted(fold(docs).where(F.col("__fold") != 2)))
    langs = [r["lang"] for r in sums.select("lang").distinct().orderBy("lang").collect()]
    if len(langs) > LANGS:
        return predict_in_blocks(docs, sums, langs)
    return predict(docs, *_matrix(sums, BUCKETS))
