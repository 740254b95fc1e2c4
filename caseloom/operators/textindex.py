"""Ranked full-text search: an inverted index as a table, and the best sections of each question.

The index is one table of postings (term, doc, tf, length), in folders by a hash of the term, and of
documents (term null) in a folder of their own.  Every `add` writes a segment, whole or not at all,
of the documents that the index lacks; a search reads the folders of its terms and no text.

A score is BM25: the sum over the question's distinct words of idf * tf / (tf + K1 * (1 - B + B * length /
mean length)), idf = ln(1 + (n - df + 1/2) / (df + 1/2)).  Every posting of an asked word counts: the work
is the sum of their frequencies, for each question, and so quadratic where questions grow with the documents.
Documents are dealt into blocks of about BLOCK, each a partition of its own; the questions, as numbers of words, pass
by every block's postings, and of a question and a block only the best leave the task.  So postings are sent once, and no
pair is ever sent.  In a block the weights of the words that many documents have are a matrix, and a group of questions is
multiplied with it; the postings of other words are added one by one.  (Bounds on what a word can add, as in MaxScore, were
tried: whole texts as questions have so many words of middling frequency that 62 % of the postings were left on 10,000
documents, and the search took longer.)

Edge cases: a null or empty text is a document of length 0 that nothing finds; a null id is passed over;
of several texts under an id one is kept, the first in order; a question without known words has no answer; equal
scores (to 6 digits) rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import sinks

WORD = r"[\p{L}\p{N}]+"
BUCKETS = 64
SALTS = 8  # writers of a folder
K1, B = 1.2, 0.75
BLOCK = 1 << 14  # documents that meet in one task
SMALL = 1 << 10  # a block has more documents than this where there are fewer blocks than cores
OFTEN, DENSE = 12, 512  # a word of one document in OFTEN has a row in a block's matrix, of DENSE rows at most
GROUP = 128  # questions multiplied at once


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def segment(docs: DataFrame) -> DataFrame:
    """bucket, term, doc, tf, length of `docs` (doc, text); a row without a term for each document."""
    once = docs.where("doc is not null").groupBy("doc").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    split = once.select(F.col("doc").cast("long").alias("doc"), words(F.col("text")).alias("ws")).withColumn("length", F.size("ws"))
    # a null term in every document makes its own row
    terms = split.select("doc", "length", F.explode(F.concat(F.col("ws"), F.array(F.lit(None).cast("string")))).alias("term"))
    counted = terms.groupBy("doc", "length", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return counted.select(F.when(F.col("term").isNull(), -1).otherwise(_bucket(F.col("term"))).alias("bucket"), "term", "doc", "tf", "length")


def add(docs: DataFrame, path: str) -> None:
    """Index the documents of `docs` (doc, text) that the index at `path` lacks."""
    if sinks.has_version(docs.sparkSession, path):
        docs = docs.join(read(docs.sparkSession, path).where("bucket = -1").select("doc"), "doc", "left_anti")
    rows = segment(docs).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "doc")
    sinks.write_version(rows, path, by="bucket")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All segments; a folder of each is read where `bucket` is asked for."""
    kept = spark.read.schema("term string, doc long, tf int, length int, bucket int")
    return reduce(DataFrame.unionByName, [kept.parquet(v) for v in sinks.all_versions(spark, path)])


def search(asked: DataFrame, path: str, most: int = 20, least: float = 0.3) -> DataFrame:
    """(query_id, rank, doc, score) of the best documents for `asked` (query_id, term), those above `least`."""
    spark = asked.sparkSession
    index = read(spark, path)
    q = asked.select("query_id", F.explode(F.array_distinct(words(F.col("term")))).alias("term")).distinct()
    buckets = [r[0] for r in q.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS
    size = index.where("bucket = -1").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = size["n"], size["mean"] or 1.0
    # only the folders of asked words are read
    post = index.where(F.col("bucket").isin(buckets))
    df = F.col("df")
    counts = post.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + (n - df + 0.5) / (df + 0.5)))
    number = (F.row_number().over(Window.partitionBy("bucket").orderBy("term")) * BUCKETS + F.col("bucket")).alias("word")
    known = counts.join(q.select("term").distinct(), "term", "left_semi").select("term", "idf", number).hint("shuffle_hash")
    part = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(max(mean, 1e-9))))
    blocks = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // SMALL)))
    kind = q.schema["query_id"].dataType.simpleString()
    block = F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block")
    # words travel as bytes: with a list among the columns a row sent to Python took many times as long
    held = post.join(known, "term").select(block, F.lit(False).alias("asks"), "word", "doc", (F.col("idf") * part).alias("weight"), F.lit(None).cast(kind).alias("query_id"), F.lit(None).cast("binary").alias("words"))
    four_bytes = F.transform(F.collect_list("word"), lambda w: F.lpad(F.hex(w), 8, "0"))  # the words of one question
    passed = q.join(known, "term").groupBy("query_id").agg(F.unhex(F.array_join(four_bytes, "")).alias("words"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    passed = passed.select(every, F.lit(True).alias("asks"), F.lit(0).alias("word"), F.lit(0).cast("long").alias("doc"), F.lit(0.0).alias("weight"), "query_id", "words")
    met = held.unionByName(passed).repartitionById(blocks, "block").sortWithinPartitions("asks").drop("block")
    best = met.mapInArrow(lambda it: _best(it, most, least), f"query_id {kind}, doc long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "doc", "score")


def _best(batches: Iterator[pa.RecordBatch], most: int, least: float) -> Iterator[pa.RecordBatch]:
    """The best documents of a block for each question: its postings come before the questions."""
    held, block = [], None
    for batch in batches:
        first = batch.num_rows - batch.column("asks").true_count
        if first:
            held.append([batch.column(c).slice(0, first).to_numpy() for c in ("word", "doc", "weight")])
        if first == batch.num_rows or not (held or block):
            continue
        if held:
            block, held = _Block(*(np.concatenate(c) for c in zip(*held, strict=True))), []
        for at in range(first, batch.num_rows, GROUP):
            rows = batch.slice(at, GROUP)
            found = block.best([np.frombuffer(w, ">i4") for w in rows.column("words").to_pylist()], most, least)
            ids = rows.column("query_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            columns = [ids, pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("query_id", ids.type), ("doc", pa.int64()), ("score", pa.float64())]))


class _Block:
    """The postings of a block of documents, by word; those of frequent words as a matrix."""

    def __init__(self, word: np.ndarray, doc: np.ndarray, weight: np.ndarray):
        order = np.argsort(word, kind="stable")
        self.docs, place = np.unique(doc, return_inverse=True)
        self.place, self.weight = place[order], weight[order]
        self.words, start = np.unique(word[order], return_index=True)
        self.start = np.append(start, len(word))
        count = np.diff(self.start)
        often = np.flatnonzero(count * OFTEN >= len(self.docs))
        often = often[np.argsort(-count[often], kind="stable")[:DENSE]]
        self.row = np.full(len(self.words), -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), len(self.docs)))
        for k, w in enumerate(often):
            at = slice(self.start[w], self.start[w + 1])
            self.matrix[k, self.place[at]] = self.weight[at]

    def best(self, asked: list[np.ndarray], most: int, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(doc, score) of the `most` highest scores above `least`, to 6 digits, for each list of words; equal ones by id."""
        has, others = np.zeros((len(asked), len(self.matrix))), []
        for k, words in enumerate(asked):
            at = np.searchsorted(self.words, words)
            at = at[self.words[np.minimum(at, len(self.words) - 1)] == words]
            row = self.row[at]
            has[k, row[row >= 0]] = 1
            others.append(at[row < 0])
        total = has @ self.matrix
        for line, at in zip(total, others, strict=True):
            spans = [slice(a, b) for a, b in zip(self.start[at].tolist(), self.start[at + 1].tolist(), strict=True)]
            if spans:
                line += np.bincount(np.concatenate([self.place[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.docs))
        return [self._first(line, most, least) for line in total]

    def _first(self, total: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        hit = np.flatnonzero(total > least - 1e-6)
        if len(hit) > most:  # scores this near to the last may be equal to it once rounded
            hit = hit[total[hit] >= np.partition(total[hit], len(hit) - most)[len(hit) - most] - 2e-6]
        score = np.floor(total[hit] * 1e6 + 0.5) / 1e6
        hit, score = hit[score > least], score[score > least]
        kept = np.lexsort((hit, -score))[:most]
        return self.docs[hit[kept]], score[kept]
