"""Near copies of whole documents: SimHash candidates by bit-sliced comparison, verified exactly.

The stage of the pipeline that belongs to operator 6.  Two documents are near copies if the sets of
their five-word shingles (A-Z lower-cased, words as in operator 6; with fewer words the whole
sequence) have a Jaccard similarity of at least 0.8; groups are what such links reach.

At 0.8 two fingerprints differ in up to 15 % of their bits, and no span of bits that rarely differs
is long enough to be a key.  So

1. every document gets a fingerprint of 256 bits and BANDS keys, each of ROWS minima of its shingles'
   hashes: a pair at 0.8 shares a key with a probability of 1 - (1 - 0.8**ROWS)**BANDS, 0.9997 with
   5 and 20, and unrelated documents share none.  Documents with one shingle set stand as one;
2. documents of a key meet in tiles of bounded size, where their bit planes are compared with carry-save
   counters; pairs within RADIUS bits (four standard deviations and more beyond 0.8) make stars;
3. only documents within such a star, or a chain of them, are read again: their whole shingle sets
   meet in tiles and every pair within RADIUS is verified, unless the tile has joined the two already;
4. the verified links give the groups.

What leaves a task is linear in its rows: stars and sets, never pairs.

Edge cases: null text counts as empty, and all empty texts are one group; null and repeated doc_ids
keep their rows apart, as groups are told by texts alone; of fully equal rows one stays; an empty
table gives an empty result; other columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import blank, durable, row_key
from .components import components
from .simhash import hits, near_wide, roles, stars
from .tiles import over_tiles, self_tiles

SHINGLE = 5
SEED = 42
SIMILARITY = (4, 5)  # as a fraction, which whole numbers are compared with
WORDS = 4  # of 64 bits in a fingerprint
RADIUS = 71
ROWS, BANDS = 5, 20
CHUNK = 512
AT_ONCE = 1 << 12  # shingles hashed at a time, which bounds memory for very long texts
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MINIMA = np.random.default_rng(SEED).integers(0, 1 << 63, (ROWS * BANDS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = mixed(out * _ODD + hashed[k : k + len(out)])
    return np.unique(out)


def fingerprint(found: np.ndarray) -> bytes:
    """WORDS * 64 bits, each set if over half of the shingles have it."""
    votes = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(found), AT_ONCE):
        part = found[k : k + AT_ONCE, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * _ODD
        votes += np.unpackbits(mixed(part).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(found), bitorder="little").tobytes()


def keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys that similar sets share; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[k : k + AT_ONCE] * _MINIMA[:, :1] + _MINIMA[:, 1:]).min(axis=1), out=least)
    band = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * _ODD + band[:, k])
    return out.view(np.int64)


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingles(t) for t in pdf.pop("text")]
        yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), digest=[xxh3_128_digest(s.tobytes()) for s in sets], print=[fingerprint(s) for s in sets], keys=[keys(s) for s in sets])


def _with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(shingles=[shingles(t).tobytes() for t in pdf.pop("text")])


def prints_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u8").reshape(-1, WORDS)


def wide(queries: np.ndarray, block_of: np.ndarray, planes: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return near_wide(queries, block_of, planes, lanes, RADIUS)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two ordered sets at or over SIMILARITY."""
    over, under = SIMILARITY
    if min(len(a), len(b)) * under < max(len(a), len(b)) * over:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum()) if len(a) else 0
    return both * under >= (len(a) + len(b) - both) * over


def verified(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Links (a, b) that join what is similar within each tile; a pair joined already is not tested."""
    ids = pdf["vid"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    root, found = list(range(len(ids))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for queries, members in hits(prints_of(pdf["print"]), *roles(pdf), wide):
        for a, b in zip(queries.tolist(), members.tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y and (ids[a] == ids[b] or similar(sets[a], sets[b])):
                root[max(x, y)] = min(x, y)
                found.append((ids[a], ids[b]))
    return pd.DataFrame(found, columns=["a", "b"]) if found else None


def grouped(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, digest of each row; digest, vid, best, component of each distinct shingle set).

    `row` is the row's key, `best` the row that stands for the set: of the least doc_id, a null one
    last, then of the least key.
    """
    rows = docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text"))
    described = durable(rows.mapInPandas(_described, "row binary, doc_id long, digest binary, print binary, keys array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    distinct = described.groupBy("digest").agg(F.min(order).alias("best"), F.first("print").alias("print"), F.first("keys").alias("keys"))
    distinct = durable(distinct.withColumn("vid", F.monotonically_increasing_id()))
    keyed = distinct.select("vid", "print", F.explode("keys").alias("key"))
    near = over_tiles(self_tiles(keyed, "key", "vid", chunk), "key", lambda pdf: stars(prints_of(pdf["print"]), pdf["vid"].to_numpy(), pdf, wide), "a long, b long")
    rough = components(near).withColumnRenamed("id", "vid").withColumnRenamed("component", "rough")
    some = durable(distinct.join(rough, "vid").select(F.col("best.row").alias("row"), "vid", "rough", "print"))
    texts = docs.select(row_key(docs).alias("row"), blank("text").alias("text")).join(some, "row")
    sets = texts.drop("row").mapInPandas(_with_sets, "vid long, rough long, print binary, shingles binary")
    sets = durable(sets.groupBy("vid").agg(*(F.first(c).alias(c) for c in ("rough", "print", "shingles"))))
    links = over_tiles(self_tiles(sets, "rough", "vid", chunk), "rough", verified, "a long, b long", rows=4096)
    joined = components(links).withColumnRenamed("id", "vid")
    named = distinct.join(joined, "vid", "left").select("digest", "vid", "best", F.coalesce("component", "vid").alias("component"))
    return described.select("row", "doc_id", "digest"), durable(named)


def one_per_group(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`docs` with exactly one row of each group, that of its least `best`; columns as they were."""
    rows, named = grouped(docs, chunk)
    best = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    equal = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = durable(best.join(equal, "row", "left").select(F.col("row").alias("kept"), (F.coalesce("n", F.lit(1)) > 1).alias("repeated")))
    return _kept(docs, kept)


def _kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose key `kept` names; equal rows once."""
    packed = docs.select(row_key(docs).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    once = packed.join(kept.where("not repeated"), F.col("row") == F.col("kept"), "left_semi")
    repeated = packed.join(kept.where("repeated"), F.col("row") == F.col("kept"), "left_semi")
    return once.unionByName(repeated.groupBy("row").agg(F.first("whole").alias("whole"))).select("whole.*")
