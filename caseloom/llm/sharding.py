"""Operator 3, sharding [native]: a Feistel permutation with cycle walking over row numbers.

Rows get global numbers 0..n-1 in the order of (bucket, doc_id, crc, size), where the bucket is a
hash of these three, so that rows without a doc_id spread too: counts per bucket are summed to offsets
and rows are numbered within their bucket, so no task ever sorts more than a bucket and no single task
numbers everything.  There are more buckets where there are more rows.  Rows that are equal in all three
are counted before any shuffle and stand as one row with its count until they have their numbers; then
they are laid out in chunks that are dealt over all tasks, so a third of all rows may be equal.  A keyed
Feistel network over Z_a x Z_b with a*b >= n, a = ceil(sqrt n), permutes them; numbers that land at
or beyond n walk on along their cycle.  At most a*b-n < a numbers lie out there, so a walk ends in
that many steps: the bound of the walk is exact, not a guess.  With p the permuted number,
shard = p mod shards and slot = p div shards: counts differ by one at most and slots have no gap.
Any (row number, seed) gives its shard and slot by arithmetic alone.

Only doc_id, the byte count and the CRC are shuffled, never texts.

Edge cases: a null text has size 8 and CRC 0; null doc_ids are numbered like others; fully equal
rows are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, mark

SHARDS = 24
SEED = 7
ROUNDS = 4  # double rounds
BUCKETS = 4096  # at least
BUCKET_ROWS = 1 << 18  # rows of a bucket to aim at
CHUNK = 1 << 16  # equal rows that one task lays out at a time


def sides(n: int) -> tuple[int, int]:
    """The sides a, b of the least near-square domain that holds n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _step(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over a number of [0, a*b)."""
    keys = F.array(*(F.lit(2 * i) for i in range(ROUNDS)))

    def double_round(s: Column, key: Column) -> Column:
        left = (s["l"] + mark(s["r"], key, seed=seed) % a) % a
        right = (s["r"] + mark(left, key + 1, seed=seed) % b) % b
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(keys, start, double_round, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """Where `number` of [0, n) goes: a bijection of [0, n)."""
    a, b = sides(n)
    once = _step(number, a, b, seed)
    if a * b == n:
        return once
    walk = lambda x: F.aggregate(
        F.sequence(F.lit(1), F.lit(a * b - n)), x, lambda y, _: F.when(y < n, y).otherwise(_step(y, a, b, seed))
    )
    return F.transform(F.array(once), lambda x: F.when(x < n, x).otherwise(walk(x)))[0]


def numbered(rows: DataFrame, buckets: int | None = None, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """Rows with doc_id, size and text_crc32, plus `number`; and how many there are."""
    n = rows.count()
    buckets = buckets or max(BUCKETS, -(-n // BUCKET_ROWS))
    bucket = (mark(F.col("doc_id"), F.col("text_crc32"), F.col("size"), seed=SEED) % buckets).alias("bucket")
    counts = rows.select(bucket).groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select(F.col("bucket").alias("at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    key = ["doc_id", "text_crc32", "size"]
    distinct = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).select("*", bucket)
    ahead = Window.partitionBy("bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("rank", F.coalesce(F.sum("copies").over(ahead), F.lit(0)))
    joined = ranked.join(offsets, F.col("bucket") == F.col("at"))
    first, copies = F.col("rank") + F.col("offset"), F.col("copies")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), copies - 1, F.lit(chunk).cast("long"))).alias("from")
    chunks = joined.select(*key, first.alias("first"), "copies", starts).repartition("first", "from")
    last = F.least(F.col("from") + chunk, copies) - 1
    return chunks.select(*key, F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + last)).alias("number")), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    text = blank("text")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, buckets)
    return rows.withColumn("p", permuted(F.col("number"), max(n, 1), seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.floor(F.col("p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )
