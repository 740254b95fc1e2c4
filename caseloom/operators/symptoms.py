"""Symptoms in the words of a taxonomy: a set-similarity join with prefix filtering.

Two sets of n and m words can have a Jaccard similarity of t only if t * n <= m <= n / t, and if they share a word among the
first n - ceil(t * n) + 1 of the one and the same of the other, in any common order of words.  With rare words first, those
prefixes meet seldom, and only what meets is compared.

Texts outnumber labels by far, so labels travel: rows of texts are dealt into partitions once, whole, and every label passes by
each of these.  There a partition's texts meet the labels by the words of their prefixes and by length, many texts at once.
Words that no label has come first in the order and meet nothing, so they only count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .linkage import overlap_tokens

LEAST = 0.45
GROUP = 256  # rows of texts that meet the labels at once
PAIRS = 1 << 20  # pairs compared at once
DIGIT = re.compile("[0-9]")
PARTS = re.compile("[0-9]+[a-z]+|[a-z]+[0-9]+")


def _keyed(rows: DataFrame, ranks: DataFrame, kept: list[str], least: float) -> DataFrame:
    """`rows` (kept, words) once for each word of their prefix: w, at (its place), known (their words that labels have, the rarest first), n (of all words).

    Words that no label has come first in the order and meet nothing, so they count but don't travel.
    """
    each = rows.select(*kept, F.size("words").alias("n"), F.explode("words").alias("word")).join(ranks, "word")
    known = each.groupBy(*kept, "n").agg(F.array_sort(F.collect_list(F.struct("labels", "word")))["word"].alias("known"))  # the words of one text
    # of the prefix's n - ceil(least * n) + 1 words, n - size(known) are words that no label has
    left = F.size("known") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1
    return known.where(left > 0).select(*kept, "n", "known", F.posexplode(F.slice("known", F.lit(1), left)).alias("at", "w"))


def _named(rows: DataFrame, keys: DataFrame | None, labels: DataFrame, least: float) -> DataFrame:
    """(id, names, scores) of `rows` (id, texts): for each text a key's label, the most similar label (with its score) or the text itself.

    `keys`: key (lower-case, distinct), by_key.  `labels`: label (distinct), place.
    """
    spark = rows.sparkSession
    e = labels.select("label", "place", overlap_tokens(T.fold_words(F.col("label"))).alias("words"))
    ranks = e.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("labels"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in [*rows.schema, *labels.schema])}
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in ("id", "place")}
    # a label's words, the rarest first; nothing meets a label without words
    sent = _keyed(e, ranks, ["label", "place"], least).where("at = 0").select(every, F.lit(0).alias("kind"), none["id"], F.col("known").alias("texts"), F.col("label").alias("name"), "place")
    if keys is not None:
        sent = sent.unionByName(keys.select(every, F.lit(1).alias("kind"), none["id"], F.array("key").alias("texts"), F.col("by_key").alias("name"), none["place"]))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("kind"), "id", "texts", F.lit(None).cast("string").alias("name"), none["place"])
    met = sent.unionByName(dealt).repartitionById(parts, "part").sortWithinPartitions("kind")
    met = met.select("kind", "id", "texts", F.when(F.col("kind") == 2, F.transform("texts", F.lower)).alias("lower"), "name", "place")
    return met.mapInArrow(lambda it: _names(it, least), f"id {kinds['id']}, names array<string>, scores array<double>")


def _names(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The labels and keys of a partition come before its rows."""
    labels, keys, found = [], {}, None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        first = int((kind < 2).sum())
        if first:
            given = (batch.column(c).slice(0, first).to_pylist() for c in ("texts", "name", "place"))
            for k, texts, name, place in zip(kind[:first], *given, strict=True):
                if k:
                    keys[texts[0]] = name
                else:
                    labels.append((place is not None, place, name, texts))
        if first < batch.num_rows and found is None:
            found, labels = _Labels(sorted(labels), least), []
        for at in range(first, batch.num_rows, GROUP):
            ids, texts, lower = (batch.column(c).slice(at, GROUP) for c in ("id", "texts", "lower"))
            texts, lower = texts.to_pylist(), lower.to_pylist()
            pairs = [[(t, low) for t, low in zip(ts, ls, strict=True)] for ts, ls in zip(texts, lower, strict=True)]
            best = found.best(list({t: None for row in pairs for t, low in row if low not in keys}))
            named = [[(keys[low] if keys[low] is not None else t, None) if low in keys else best.get(t, (t, None)) for t, low in row] for row in pairs]
            columns = [ids, pa.array([[n for n, _ in row] for row in named], pa.list_(pa.string())), pa.array([[x for _, x in row] for row in named], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("id", ids.type), ("names", columns[1].type), ("scores", columns[2].type)]))


def _tokens(text: str) -> set[str]:
    """`overlap_tokens` of `fold_words`, of one text."""
    plain = T.plain_words(text)
    words = set(plain.split())
    if DIGIT.search(plain):
        for w in [w for w in words if PARTS.fullmatch(w)]:
            words |= {re.match("[0-9]+|[a-z]+", w)[0], re.search("(?:[0-9]+|[a-z]+)$", w)[0]}
    return words


def _prefix(n: int, least: float) -> int:
    """How many of n words must hold one in common."""
    return n - math.ceil(least * n - 1e-9) + 1


class _Labels:
    """Labels by the words of their prefixes; of one word, by their number of words."""

    def __init__(self, labels: list[tuple], least: float):
        """`labels`: (.., label, its words, the rarest first), in order of place."""
        self.least, self.names, words = least, [x[-2] for x in labels], [x[-1] for x in labels]
        count = Counter(w for ws in words for w in ws)
        self.rank = {w: k for k, w in enumerate(w for _, w in sorted((n, w) for w, n in count.items()))}
        self.bit = [1 << (k * 0x9E3779B97F4A7C15 >> 58 & 63) for k in range(len(count))]
        ids = [[self.rank[w] for w in ws] for ws in words]
        self.sets = [frozenset(i) for i in ids]
        self.size = np.array([len(i) for i in ids], np.int64)
        self.sign = np.array([self._sign(i) for i in ids], np.uint64)
        self.longest = int(self.size.max(initial=0)) + 1
        heads = [i[: _prefix(len(i), least)] for i in ids]
        many = np.array([len(h) for h in heads], np.int64)
        label = np.repeat(np.arange(len(heads)), many)
        key = np.array([w for h in heads for w in h], np.int64) * self.longest + self.size[label]
        order = np.argsort(key, kind="stable")
        self.key, self.label = key[order], label[order]
        self.at = (np.arange(len(label)) - np.repeat(np.cumsum(many) - many, many))[order]

    def _sign(self, ids: list[int]) -> int:
        """A bit for each word, of 64."""
        sign = 0
        for k in ids:
            sign |= self.bit[k]
        return sign

    def best(self, texts: list[str]) -> dict[str, tuple[str, float]]:
        """(label, score) of the most similar label of each text that has one of `least` or more; of equal ones the first."""
        n, sets, sign, known, word, text, at = [], [], [], [], [], [], []
        for k, t in enumerate(texts):
            tokens = _tokens(t)
            ids = sorted(map(self.rank.__getitem__, tokens & self.rank.keys()))
            n.append(len(tokens))
            known.append(len(ids))
            sets.append(ids)
            left = _prefix(len(tokens), self.least) - (len(tokens) - len(ids))
            sign.append(self._sign(ids) if left > 0 else 0)
            if left > 0:
                word += ids[:left]
                text += [k] * min(left, len(ids))
                at += range(min(left, len(ids)))
        n, known, sign = np.array(n, np.int64), np.array(known, np.int64), np.array(sign, np.uint64)
        word, text, at = (np.array(c, np.int64) for c in (word, text, at))
        low = np.ceil(self.least * n[text] - 1e-9).astype(np.int64)
        high = np.minimum(np.floor(n[text] / self.least + 1e-9).astype(np.int64), self.longest - 1)
        start = np.searchsorted(self.key, word * self.longest + np.minimum(low, self.longest))
        many = np.maximum(np.searchsorted(self.key, word * self.longest + high, "right") - start, 0)
        best: dict[int, tuple[float, int]] = {}
        ends = np.cumsum(many)
        cut = 0
        while cut < len(many):  # as many meetings as make up PAIRS pairs, one at least
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, "right")))
            for k, label, score in self._similar(*(c[cut:to] for c in (text, at, start, many)), n, known, sign, sets):
                if (-score, label) < best.get(k, (1.0, 0)):
                    best[k] = (-score, label)
            cut = to
        return {texts[k]: (self.names[label], -score) for k, (score, label) in best.items()}

    def _similar(self, text, at, start, many, n, known, sign, sets) -> Iterator[tuple[int, int, float]]:
        """(text, label, score) of the pairs that are similar enough, among those that meet."""
        post = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
        t, a, label = np.repeat(text, many), np.repeat(at, many), self.label[post]
        # what two sets need in common; at their first common word enough words must be left on either side
        least = self.least * (n[t] + self.size[label]) / (1 + self.least) - 1e-6
        rest = np.minimum(known[t] - a, self.size[label] - self.at[post])
        t, label, least = (c[rest >= least] for c in (t, label, least))
        # each bit that only one of them has is a word that the other lacks
        mine, its = sign[t], self.sign[label]
        most = np.minimum(known[t] - np.bitwise_count(mine & ~its), self.size[label] - np.bitwise_count(its & ~mine))
        t, label = t[most >= least], label[most >= least]
        for pair in np.unique(t * len(self.names) + label).tolist():
            k, of = divmod(pair, len(self.names))
            both = len(self.sets[of].intersection(sets[k]))
            score = both / (int(n[k]) + len(self.sets[of]) - both)
            if score >= self.least:
                yield k, of, score


def similar_labels(texts: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """(text, label, score) of the most similar label for each of `texts` (text, distinct), the first by `place` of equal ones.

    `labels`: label (distinct), place.  Texts without a label of `least` or more are left out.
    """
    found = _named(texts.where("text is not null").select(F.col("text").alias("id"), F.array("text").alias("texts")), None, labels, least)
    return found.select(F.col("id").alias("text"), F.col("names")[0].alias("label"), F.col("scores")[0].alias("score")).where("score is not null")


def canonical_symptoms(cases: DataFrame, taxonomy: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, symptoms) of `cases` (id, symptoms) in the labels of `taxonomy` (key, label, place), each once, in order; each row by itself.

    A key, in either case, stands for its label; any other text for the most similar label, if one is similar enough;
    else for itself.  Null and empty symptoms go.
    """
    given = F.filter(F.transform(F.coalesce("symptoms", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    keys = taxonomy.where("key is not null").groupBy(F.lower("key").alias("key")).agg(F.min_by("label", "place").alias("by_key"))
    labels = taxonomy.where("label is not null").groupBy("label").agg(F.min("place").alias("place"))
    found = _named(cases.select("id", given.alias("texts")), keys, labels, least)
    return found.select("id", F.array_distinct("names").alias("symptoms"))


def sentences(text: Column) -> Column:
    """The sentences of a whole text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]"), lambda s: F.trim(s)), lambda s: s != "")
