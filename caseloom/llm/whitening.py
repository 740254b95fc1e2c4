"""Operator 13, embedding whitening: covariance by digit-slice products, exact to the last unit.

Entries become integers x = floor(64 * c) + 1000000.  Their mean is large beside their spread, so a
covariance from plain sums of products in doubles loses most of its digits.  Here nothing is lost:
with n vectors and the sums S of each dimension, y = n * x - S is an integer and the centred row times
n.  Every y is split into limbs of a few bits; products of limb matrices over a bounded block of rows
stay below 2**53, so float64 BLAS gives them exactly.  The limb products are recombined as big integers,
cut into digits of base 2**DIGIT, summed by Spark over all tasks, and put together again: G, the sum of
all y y', is exact, and V = G / n**3 is rounded once.  Its eigenvectors, by falling eigenvalue, are the
components; a row's whitened value is y / n along a component over the root of its eigenvalue.

A task holds one block of rows and one matrix of the width squared; what reaches the driver is the
sums and the matrix, whose size depends on the width alone.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; a null
vec_id is carried through and repeated ones are rows of their own; vectors of each width are a fit list
of their own; 64 * c beyond a long is cut to its range; a component whose eigenvalue is not above TINY
times the greatest has no variance to scale and is left out, so that equal vectors alone give no rows;
a deviation beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: The scale and offset of the integers, and how many components are returned.
SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 32
BLOCK = 4096  # rows of a product
LIMB = 20  # bits: BLOCK * 2**(2 * LIMB) < 2**53
DIGIT = 40  # bits of the digits that Spark sums: 2**22 tasks stay within a long
TINY = 1e-10  # an eigenvalue is off by some 1e-15 of the greatest: this leaves 5 digits of the least
LONG = np.iinfo(np.int64)

SUMMED = "width int, i int, j int, digit int, value long"


def usable(table: DataFrame) -> DataFrame:
    """vec_id, width and the packed vector of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0)).withColumn("width", F.size("embedding"))


def integers(vectors: pd.Series) -> np.ndarray:
    """x of each entry; as Python's integers where the offset would leave a long."""
    scaled = np.floor(SCALE * np.stack(vectors.to_numpy()).astype(np.float64))
    if np.abs(scaled).max(initial=0) < 2.0**62:
        return scaled.astype(np.int64) + OFFSET
    cut = np.clip(scaled, -(2.0**63), 2.0**63 - 1024)
    return np.clip(np.array([[int(v) for v in row] for row in cut], object) + OFFSET, LONG.min, LONG.max)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """y = n * x - S, exactly: in longs where they hold it, else in Python's integers."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(s)) for s in sums)
    if most < 2**62:
        return n * x.astype(np.int64) - sums.astype(np.int64)
    return n * x.astype(object) - sums


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Slices of LIMB bits as doubles, the lowest first; the last one carries the sign."""
    out = []
    while True:
        if not len(y) or max(abs(int(y.max())), abs(int(y.min()))) < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def gram(y: np.ndarray) -> np.ndarray:
    """y' y in Python's integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK):
        part = limbs(y[at : at + BLOCK])
        for p, left in enumerate(part):
            for q, right in enumerate(part[: p + 1]):
                product = (left.T @ right).astype(np.int64).astype(object)  # each sum is below 2**53
                total += (product if p == q else product + product.T) << (LIMB * (p + q))
    return total


def digits(i: np.ndarray, j: np.ndarray, values: np.ndarray, width: int) -> pd.DataFrame:
    """`values` in digits of base 2**DIGIT, the last one with the sign."""
    out, k = [], 0
    while True:
        last = not len(values) or max(abs(int(v)) for v in values) < 1 << DIGIT
        low = values if last else values & ((1 << DIGIT) - 1)
        out.append(pd.DataFrame({"width": width, "i": i, "j": j, "digit": k, "value": low.astype(np.int64)}))
        if last:
            return pd.concat(out, ignore_index=True)
        values, k = values >> DIGIT, k + 1


def _summed(rows: DataFrame, work) -> dict[int, dict[tuple[int, int], int]]:
    """What `work` emits (SUMMED), added up over all tasks: width -> (i, j) -> exact sum."""
    parts = durable(rows.mapInPandas(work, SUMMED).groupBy("width", "i", "j", "digit").agg(F.sum("value").alias("value")))
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.toLocalIterator():  # a few digits for each cell of a matrix of the width
        cells = out.setdefault(r["width"], {})
        cells[r["i"], r["j"]] = cells.get((r["i"], r["j"]), 0) + (r["value"] << (DIGIT * r["digit"]))
    return out


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per width the sums of x as (i, -1), and the number of rows as (-1, -1)."""
    held: dict[int, np.ndarray] = {}
    for pdf in batches:
        for width, part in pdf.groupby("width"):
            x = integers(part["embedding"])
            small = x.dtype != object and int(np.abs(x.astype(float)).max()) * len(x) < 2**61
            total = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            held[width] = held.get(width, 0) + np.append(total.astype(object), len(x))
    for width, total in held.items():
        yield digits(np.append(np.arange(width), -1), np.full(width + 1, -1), total, width)


def totals(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """width -> (n, S)."""
    found = _summed(rows.select("width", "embedding"), _sums)
    return {w: (cells[-1, -1], np.array([cells[i, -1] for i in range(w)], object)) for w, cells in found.items()}


def scatter(rows: DataFrame, lists: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """width -> G, the exact sum of y y'."""

    def work(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for width, part in pdf.groupby("width"):
                held[width] = held.get(width, 0) + gram(centred(integers(part["embedding"]), *lists[width]))
        for width, total in held.items():
            i, j = np.tril_indices(width)
            yield digits(i, j, total[i, j], width)

    out = {}
    for width, cells in _summed(rows.select("width", "embedding"), work).items():
        total = np.zeros((width, width), object)
        for (i, j), value in cells.items():
            total[i, j] = total[j, i] = value
        out[width] = total
    return out


class Whitening:
    """The components of one fit list: (n, S), unit eigenvectors as columns, eigenvalues, trace."""

    def __init__(self, n: int, sums: np.ndarray, total: np.ndarray):
        self.n, self.sums = n, sums
        cube = n**3
        covariance = np.array([[float(Fraction(int(v), cube)) for v in row] for row in total])
        trace = float(Fraction(int(np.trace(total)), cube))
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        some = int((values > TINY * values[0]).sum()) if values[0] > 0 else 0
        keep = min(some, COMPONENTS)
        self.values, self.vectors = values[:keep], vectors[:, :keep]
        self.explained = self.values / trace if keep else self.values

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def identity_errors(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """width -> how far the covariance of the whitened values, over all rows, is from the identity."""

    def work(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for width, part in pdf.groupby("width"):
                m = models[width]
                if len(m.values):
                    w = m.whitened(centred(integers(part["embedding"]), m.n, m.sums))
                    held[width] = held.get(width, 0.0) + w.T @ w / m.n
        for width, total in held.items():
            i, j = np.tril_indices(len(total))
            yield pd.DataFrame({"width": width, "i": i, "j": j, "value": total[i, j]})

    cells = rows.select("width", "embedding").mapInPandas(work, "width int, i int, j int, value double")
    cells = cells.groupBy("width", "i", "j").agg(F.sum("value").alias("value"))
    off = F.abs(F.col("value") - (F.col("i") == F.col("j")).cast("double"))
    return {r["width"]: r["e"] for r in cells.groupBy("width").agg(F.max(off).alias("e")).collect()}


def whiten(table: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; see the module.

    y sums to 0 in each dimension, so the whitened values are centred before they are multiplied too.
    """
    rows = durable(usable(table))
    lists = totals(rows)
    models = {w: Whitening(*lists[w], total) for w, total in scatter(rows, lists).items()}
    errors = identity_errors(rows, models)
    shared = table.sparkSession.sparkContext.broadcast((models, errors))  # matrices of the width

    def project(batches):
        models, errors = shared.value
        for pdf in batches:
            for width, part in pdf.groupby("width"):
                m, k = models[width], len(models[width].values)
                if not k:
                    continue
                y = centred(integers(part["embedding"]), m.n, m.sums)
                if float(np.abs(y).max()) ** 2 * width < 2**62:
                    deviation = pd.array((y.astype(np.int64) ** 2).sum(axis=1), "Int64")
                else:
                    exact = (y.astype(object) ** 2).sum(axis=1)
                    deviation = pd.array([int(d) if d <= LONG.max else None for d in exact], "Int64")
                yield pd.DataFrame(
                    {
                        "vec_id": pd.array(part["vec_id"], "Int64").repeat(k),
                        "component": np.tile(np.arange(1, k + 1), len(part)),
                        "n": m.n,
                        "deviation": deviation.repeat(k),
                        "whitened": m.whitened(y).ravel(),
                        "explained": np.tile(m.explained, len(part)),
                        "identity_error": errors[width],
                    }
                )

    return rows.mapInPandas(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
