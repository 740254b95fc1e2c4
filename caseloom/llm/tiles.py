"""Joins of rows that share a key, in tiles of bounded size.

A key may hold a third of all rows.  Its rows are dealt into chunks of at most about `chunk` rows by
a hash, and every pair of chunks becomes a tile of its own: no task holds more than two chunks of a
key at once, whatever the key's size, and no pair of rows is left out.  The sizes of keys are written
to the shared folder first, so Spark knows their bytes: it broadcasts them where they are few, and
otherwise exchanges both sides and can split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

CHUNK = 1024


def self_tiles(rows: DataFrame, key: str, by: str, chunk: int = CHUNK) -> DataFrame:
    """`rows` with tile_a <= tile_b and side (0: chunk a, 1: chunk b), for all pairs within a key.

    Keys with a single row have no pair and are left out.  `by` tells rows of a key apart.
    """
    counts = durable(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    dealt = rows.join(counts, key).withColumn("__chunks", F.ceil(F.col("__n") / chunk).cast("int"))
    dealt = dealt.withColumn("__c", F.pmod(F.xxhash64(by), F.col("__chunks")).cast("int"))
    other = dealt.withColumn("__d", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    return other.select(*rows.columns, F.least("__c", "__d").alias("tile_a"), F.greatest("__c", "__d").alias("tile_b"), (F.col("__c") > F.col("__d")).cast("int").alias("side"))


def over_tiles(tiles: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, rows: int = 16_384) -> DataFrame:
    """`work` on frames that hold whole tiles only, with about `rows` rows at least, or one tile.

    The frames have a column ``tile``, a number per tile, and are in order of it.
    """
    by = [key, "tile_a", "tile_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(whole: bool):
            nonlocal held, size
            pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            new = np.ones(len(pdf), bool)
            new[1:] = np.logical_or.reduce([(v := pdf[c].to_numpy())[1:] != v[:-1] for c in by])
            start = int(np.flatnonzero(new)[-1]) if not whole else len(pdf)
            held = [pdf.iloc[start:].reset_index(drop=True)] if start < len(pdf) else []
            size = len(pdf) - start
            if not start:
                return None
            done = pdf.iloc[:start].copy()
            done["tile"] = np.cumsum(new[:start]) - 1
            return work(done)

        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                size += len(pdf)
                if size >= rows and (out := flush(False)) is not None and len(out):
                    yield out
        if size and (out := flush(True)) is not None and len(out):
            yield out

    return tiles.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between places of `ids` thinned to a star per component: (id, least id).

    `ids` may repeat; equal ids are one vertex.  Only ids other than their star's centre appear.
    """
    names, at = np.unique(ids, return_inverse=True)
    a, b = at[a], at[b]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != (again := new[new])).any():
            new = again
        if (new == root).all():
            break
        root = new
    away = root != np.arange(len(names))
    return names[away], names[root[away]]
