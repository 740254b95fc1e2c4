"""Operator 6, SimHash near-duplicates by bit-sliced comparison.

Fingerprint: A-Z are lower-cased, words are runs of other than ASCII white space, and every 3-word
shingle (repeats count; with fewer words the whole sequence) votes with its XXH64 (seed 42) on 64
bits; a bit is set if set in over half the hashes.  A text without words has fingerprint zero.

Links (at most 3 differing bits): fingerprints are first made distinct, so copies meet once.  The 64
bits are cut into `blocks` spans; two fingerprints that differ in r bits agree in at least
blocks - r spans, so they meet under one key of that many spans.  More distinct fingerprints call for
more spans: longer keys keep buckets small.  Buckets are split into tiles of bounded size, and in a
tile up to 64 members stand vertically: word p holds bit p of all of them.  Each query is compared
with a whole block at once; the differing bits are counted for all 64 lanes by carry-save counters,
and a block is given up as soon as every lane has passed the radius.

A tile's links are thinned to stars, so what leaves it is linear in its rows; components follow.

Edge cases: null text counts as empty; all empty texts share fingerprint zero and so a group; null
doc_ids keep their rows and never name a group unless it has no other id; repeated rows each get
their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import blank, durable
from .components import components
from .tiles import CHUNK, forest, over_tiles, self_tiles

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Distinct fingerprints up to which that many spans will do: about CHUNK in a bucket at most.
SPANS = ((4, 1 << 26), (5, 1 << 36), (6, 1 << 62))
VOTES = 1 << 16  # hashes counted at a time


def fingerprint(text: str) -> int:
    """Unsigned; see above."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for k in range(0, len(starts), VOTES):
        hashes = [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[k : k + VOTES], ends[k : k + VOTES], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        prints = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
        yield pdf.drop(columns="text").assign(doc_id=pdf["doc_id"].astype("Int64"), fp=prints)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text")).mapInPandas(_fingerprints, "doc_id long, fp long")


def spans(blocks: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each span."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def keyed(prints: DataFrame, blocks: int, radius: int = RADIUS) -> DataFrame:
    """fp under each of its keys: one for every choice of blocks - radius spans.

    A key is a hash of the spans' bits: a collision adds comparisons and loses none.
    """
    cut = spans(blocks)

    def key(which: tuple[int, ...]):
        parts = [F.shiftrightunsigned("fp", cut[k][0]).bitwiseAND(F.lit((1 << cut[k][1]) - 1)) for k in which]
        return F.xxhash64(F.lit(sum(1 << k for k in which)), *parts)

    keys = F.array(*(key(c) for c in itertools.combinations(range(blocks), blocks - radius)))
    return prints.select("fp", F.explode(keys).alias("key"))


def vertical(members: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 prints of one or more words: word p of a row holds bit p of its members as lanes."""
    rows, lanes, words = members.shape
    bits = np.unpackbits(members.astype("<u8").view(np.uint8).reshape(rows, lanes, 8 * words), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(rows, 64 * words)


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _differing(queries: np.ndarray, blocks: np.ndarray, planes: np.ndarray, p: int) -> np.ndarray:
    """Lanes whose bit p differs from the query's."""
    bit = (queries[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
    return planes[blocks, p] ^ np.where(bit, FULL, np.uint64(0))


def near(queries: np.ndarray, block_of: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(item, lanes within the radius) where query i meets block block_of[i]; lanes: valid ones.

    Two counter bits and an overflow, for a radius of at most 3.
    """
    if radius >= 4:
        raise ValueError("two counter bits and an overflow count to 3")
    item = np.arange(len(queries))
    out = ~lanes[block_of]  # lanes that are out: no member there, or too far
    one, two = np.zeros(len(item), np.uint64), np.zeros(len(item), np.uint64)
    query, block = queries, block_of
    for p in range(planes.shape[1]):
        x = _differing(query, block, planes, p)
        carry = one & x
        one ^= x
        out |= two & carry  # a fourth difference
        two ^= carry
        if p % 4 == 3:
            live = out != FULL
            if not live.all():
                item, query, block, out, one, two = (v[live] for v in (item, query, block, out, one, two))
            if not len(item):
                break
    if radius < 3:
        bit1, bit2 = one, two
        out |= {2: bit1 & bit2, 1: bit2, 0: bit1 | bit2}[radius]
    return item, ~out


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, carry) of three bits in every lane: a carry-save adder."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near_wide(queries: np.ndarray, block_of: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As `near`, for any radius of 8 m - 1: eight planes at a time go through carry-save adders.

    What is left of them, one bit that counts eights, goes into counters that start m short of their
    overflow, so a lane is out when it has differed 8 m times.
    """
    m = (radius + 1) // 8
    if radius != 8 * m - 1 or m < 1:
        raise ValueError("the radius must be one less than a multiple of 8")
    high = m.bit_length()
    start = (1 << high) - m
    n = len(queries)
    item, query, block, out = np.arange(n), queries, block_of, ~lanes[block_of]
    state = [np.zeros(n, np.uint64) for _ in range(3)] + [np.full(n, FULL if start >> k & 1 else np.uint64(0)) for k in range(high)]
    for p in range(0, planes.shape[1], 8):
        x = [_differing(query, block, planes, p + k) for k in range(8)]
        ones, twos, fours, *eights = state
        carries = []
        for k in range(0, 8, 2):
            ones, c = _add(ones, x[k], x[k + 1])
            carries.append(c)
        twos, first = _add(twos, carries[0], carries[1])
        twos, second = _add(twos, carries[2], carries[3])
        fours, carry = _add(fours, first, second)
        for k in range(high):
            eights[k], carry = eights[k] ^ carry, eights[k] & carry
        out = out | carry
        state = [ones, twos, fours, *eights]
        if p % 64 == 56:
            live = out != FULL
            if not live.all():
                item, query, block, out = item[live], query[live], block[live], out[live]
                state = [v[live] for v in state]
            if not len(item):
                break
    return item, ~out


def hits(prints: np.ndarray, tile: np.ndarray, is_query: np.ndarray, is_member: np.ndarray, compare: Callable, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) places that `compare` finds within each tile, a bounded number of blocks at a time."""
    at = np.flatnonzero(is_member)
    if not len(at):
        return
    # members of a tile in blocks of 64 lanes
    tiles, first, count = np.unique(tile[at], return_index=True, return_counts=True)
    lane = np.arange(len(at)) - np.repeat(first, count)
    blocks = -(-count // 64)
    base = np.cumsum(blocks) - blocks
    row = np.repeat(base, count) + lane // 64
    members = np.zeros((int(blocks.sum()), 64, prints.shape[1]), np.uint64)
    place = np.full((int(blocks.sum()), 64), -1, np.int64)
    members[row, lane % 64], place[row, lane % 64] = prints[at], at
    valid = np.bitwise_or.reduce(np.where(place >= 0, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)), axis=1)
    planes = vertical(members)
    # every query meets every block of its tile
    q = np.flatnonzero(is_query)
    k = np.searchsorted(tiles, tile[q])
    met = (k < len(tiles)) & (tiles[np.minimum(k, len(tiles) - 1)] == tile[q])
    q, k = q[met], k[met]
    ends = np.cumsum(blocks[k])
    start = 0
    while start < len(q):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit)))
        qs, ks = q[start:stop], k[start:stop]
        n = blocks[ks]
        query = np.repeat(qs, n)
        block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base[ks], n)
        item, hit = compare(prints[query], block, planes, valid)
        i, j = np.nonzero(np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield query[item[i]], place[block[item[i]], j]
        start = stop


def roles(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tile, is_query and is_member of a frame of whole tiles."""
    side, own = pdf["side"].to_numpy(), (pdf["tile_a"] == pdf["tile_b"]).to_numpy()
    return pdf["tile"].to_numpy(), own | (side == 0), own | (side == 1)


def stars(prints: np.ndarray, ids: np.ndarray, pdf: pd.DataFrame, compare: Callable) -> pd.DataFrame | None:
    """Links within each tile, thinned to stars: a, b."""
    found = []
    for a, b in hits(prints, *roles(pdf), compare):
        other = ids[a] != ids[b]
        if other.any():
            x, r = forest(a[other], b[other], ids)
            found.append(pd.DataFrame({"a": x, "b": r}))
    return pd.concat(found, ignore_index=True).drop_duplicates() if found else None


def linked(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Stars of the links within each tile of a frame with tile, side, tile_a, tile_b, fp."""
    fp = pdf["fp"].to_numpy()
    return stars(fp.view(np.uint64)[:, None], fp, pdf, near)


def joined(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """`distinct`, which has each fp once and should be durable, with component: the least fp that fp reaches."""
    if radius != RADIUS:
        raise ValueError("the counters are built for a radius of 3")
    if blocks is None:
        n = distinct.count()
        blocks = next(b for b, most in SPANS if n <= most)
    tiles = self_tiles(keyed(distinct.select("fp"), blocks, radius), "key", "fp", chunk)
    links = over_tiles(tiles, "key", linked, "a long, b long")
    named = distinct.join(components(links), distinct["fp"] == F.col("id"), "left").select(*distinct.columns, F.coalesce("component", "fp").alias("component"))
    return durable(named)


def groups(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """component_id by fp: the least doc_id of all that its fingerprint reaches.

    `prints` has doc_id and fp; it should be durable, as it is read more than once.
    """
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = joined(distinct, radius, blocks, chunk)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return durable(named.join(durable(least), "component").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id of every row."""
    prints = durable(fingerprints(docs))
    by_print = groups(prints, chunk=chunk)
    return prints.join(by_print, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
