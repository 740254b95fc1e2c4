"""Operator 4, embedding near-dedup: a subspace pigeonhole join.

Vectors are scaled to length 1 and rotated by a fixed orthogonal matrix, which spreads what they
differ in over all coordinates.  cosine >= c means a squared distance of at most 2 - 2c.  The rotated
coordinates are cut into blocks; by the pigeonhole principle a linked pair is, in some block, within
that block's share of the squared distance (in proportion to its width).  Each block is range-joined
under its own budget, and the union of the candidates is verified with the original vectors in
double precision.

The range joins run in tiles of bounded size: the vectors of a label are dealt into chunks, every
pair of chunks meets in one task, and one matrix product per block gives all its squared distances
there.  A vector so travels once per chunk of its label, whatever the number of blocks.  Grid cells
over a block's coordinates would be keys as well, but a block's radius is about as long as the spread
of a coordinate at the cosines of interest, so that cells with their neighbours hold most of a label
and a vector would travel dozens of times; the README has the figures.

A tile passes on counts and a star forest, which is linear in its rows, and never its pairs.

Vectors are compared only under equal labels and widths.  Equal vectors of a label are joined first
and stand as one with their number; each has the others as links.

Edge cases: null vectors, zero vectors, vectors with a null or non-finite component, and rows with a
null label link with nothing: n_links 0, component_id their own vec_id, kept true.  A null vec_id is
carried through and never names a component that has another id.  Rows that repeat a vec_id count as
vectors of their own.  Empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import components
from .tiles import forest, over_tiles, self_tiles

COSINE = 0.93
BLOCK = 8  # coordinates of a block
SEED = 11
SLACK = 2e-5  # of squared distances, for rounding in the rotation and in single-precision products
CHUNK = 4096  # rows of a side of a tile
QUERIES = 512  # rows of a tile compared with the rest at a time
AT_ONCE = 1 << 16  # pairs verified at a time


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def cuts(width: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """(start, stop) of each block."""
    n = max(1, round(width / block))
    edges = [width * k // n for k in range(n + 1)]
    return list(itertools.pairwise(edges))


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit length, rotated."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(vectors.shape[1])


def _packed(batches, single: bool):
    """Vectors as bytes of their own precision: an array column costs twice that and more."""
    for pdf in batches:
        kind = np.float32 if single else np.float64
        yield pdf.assign(embedding=[np.asarray(e, kind).tobytes() for e in pdf["embedding"]])


def unpacked(cells: pd.Series, width: int) -> np.ndarray:
    """Doubles of packed vectors of one width."""
    data = b"".join(cells)
    kind = np.float32 if len(data) == 4 * width * len(cells) else np.float64
    return np.frombuffer(data, kind).reshape(-1, width).astype(np.float64)


def _stretched(part: np.ndarray, query: bool) -> np.ndarray:
    """Rows whose products, of a query and another, are squared distances."""
    norm, one = (part**2).sum(axis=1, keepdims=True), np.ones((len(part), 1))
    return np.hstack([-2 * part, norm, one] if query else [part, one, norm]).astype(np.float32)


def let_through(queries: np.ndarray, members: np.ndarray, cosine: float) -> np.ndarray:
    """Which (query, member) some block lets through: within its share of the squared distance.

    Both are turned vectors.  Every pair with that cosine is among them.
    """
    width = queries.shape[1]
    some = np.zeros((len(queries), len(members)), bool)
    for start, stop in cuts(width):
        budget = (2 - 2 * cosine) * (stop - start) / width + SLACK
        far = _stretched(queries[:, start:stop], True) @ _stretched(members[:, start:stop], False).T
        some |= far <= np.float32(budget)
    return some


def linked(raw: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows `left` and rows `right` of `raw`, each once; the same rows twice: within them."""
    place = turned(raw)
    length = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    within = left is right
    found = [(left[:0], right[:0])]
    for at in range(0, len(left), QUERIES):
        rows, others = left[at : at + QUERIES], right[at if within else 0 :]
        some = let_through(place[rows], place[others], cosine)
        i, j = np.nonzero(np.triu(some, 1) if within else some)
        for k in range(0, len(i), AT_ONCE):
            a, b = rows[i[k : k + AT_ONCE]], others[j[k : k + AT_ONCE]]
            near = np.einsum("ij,ij->i", raw[a], raw[b]) / (length[a] * length[b]) >= cosine
            found.append((a[near], b[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _verify(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame | None:
    """Counts and stars of the links of each tile; see `links`."""
    out = []
    for _, rows in pdf.groupby("tile", sort=False):
        raw = unpacked(rows["embedding"], int(rows["width"].iloc[0]))
        vid, mult, side = rows["vid"].to_numpy(), rows["mult"].to_numpy(), rows["side"].to_numpy()
        if rows["tile_a"].iloc[0] == rows["tile_b"].iloc[0]:
            left = right = np.arange(len(rows))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = linked(raw, left, right, cosine)
        if len(a):
            n = (np.bincount(a, mult[b], len(rows)) + np.bincount(b, mult[a], len(rows))).astype(np.int64)
            hit = np.flatnonzero(n)
            v, r = forest(a, b, vid)
            out += [pd.DataFrame({"a": vid[hit], "b": -1, "n": n[hit]}), pd.DataFrame({"a": v, "b": r, "n": 0})]
    return pd.concat(out, ignore_index=True) if out else None


def links(distinct: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """a, b, n: rows with b = -1 add n to the links of a, rows with n = 0 link a and b.

    `distinct` has vid (0 or more, unique), label, width, mult, embedding (packed); it should be durable.
    """
    keyed = distinct.withColumn("key", F.shiftleft(F.col("label").cast("long"), 32).bitwiseOR(F.col("width").cast("long"))).drop("label")
    tiles = self_tiles(keyed, "key", "vid", chunk)
    return over_tiles(tiles, "key", lambda pdf: _verify(pdf, cosine), "a long, b long, n long", rows=4096)


def near_duplicates(table: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `table` (vec_id, embedding, label)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    same = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    rows = rows.withColumn("same", F.when(F.col("usable"), same))
    distinct = rows.where("usable").groupBy("same").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    single = table.schema["embedding"].dataType.simpleString() == "array<float>"
    kept = distinct.select("same", F.monotonically_increasing_id().alias("vid"), "label", F.size("embedding").alias("width"), "mult", "least", "embedding")
    distinct = durable(kept.mapInPandas(lambda it: _packed(it, single), "same string, vid long, label int, width int, mult long, least long, embedding binary"))
    found = durable(links(distinct.select("vid", "label", "width", "mult", "embedding"), cosine, chunk))
    counted = found.where("b = -1").groupBy(F.col("a").alias("vid")).agg(F.sum("n").alias("n"))
    joined = components(found.where("n = 0").select("a", "b")).withColumnRenamed("id", "vid")
    named = distinct.select("same", "vid", "mult", "least").join(counted, "vid", "left").join(joined, "vid", "left")
    named = durable(named.select("same", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "vid").alias("component")))
    least = durable(named.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = durable(named.join(least, "component").select(F.col("same").alias("of"), "n_links", "component_id"))
    out = rows.select("vec_id", "same").join(classes, F.col("same") == F.col("of"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id").eqNullSafe(component), F.lit(True)).alias("kept"))
