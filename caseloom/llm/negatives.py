"""Operator 12, hard-negative mining: a vector-approximation file.

Every component becomes an integer, and every dimension is cut into CELLS cells, so that a row's
approximation is half a byte for each dimension.  For an anchor a and a cell [lo, hi] of dimension i the
products a_i * lo and a_i * hi bound what any member of the cell adds to the score; a table of these
bounds, two dimensions to a byte, turns a row's bytes into an upper and a lower bound of its score by
lookups and additions.  Only rows whose bounds may still enter a window are scored, exactly, with their
integers.  Two passes over the file: the first finds the best rows of an anchor's own label, the
second those of other labels below each of them.

Anchors are dealt into chunks of about ANCHORS; each chunk meets all rows, in SPLITS tasks through
which the rows stream in blocks.  A task keeps the best `k` of each of its anchors' windows, whose last
score prunes the blocks that follow, and passes on nothing else: what it emits does not depend on the
number of rows, equal vectors and ties included.  The windows of all splits are merged by Spark.

The cells are cut at quantiles of at most SAMPLE rows; the outer cells reach the least and greatest
value of all rows, so the bounds hold for every row and the results are exact whatever the sample.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; a
null vec_id is no anchor, keeps its label and comes last among ties; rows that repeat a vec_id are rows
of their own, and a row is "other" than its twin; vectors are compared within equal widths only, those of
width 0 not at all; an anchor without positives, and a positive without negatives in its window, give
no rows; scores beyond a long are cut to its range; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

CELLS = 16  # to a dimension: half a byte
SAMPLE = 8192  # rows that the cuts between cells are taken from
ANCHORS = 4096  # to a chunk
SPLITS = 16  # tasks that share the rows of a chunk of anchors
BLOCK = 8192  # rows bounded at a time
AT_ONCE = 64  # anchors bounded at a time
SCORED = 1 << 16  # pairs scored at a time
KEPT = 5

ROW = "uid long, vid long, none boolean, label long, width int, exact binary"
LONG = np.iinfo(np.int64)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as integers of the least of three sizes that holds them."""
    for pdf in batches:
        out = []
        for e in pdf["embedding"]:
            x = np.clip(np.floor(256 * np.asarray(e, np.float64)), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            most = int(np.abs(x.astype(np.float64)).max())
            out.append(x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes())
        yield pdf.drop(columns="embedding").assign(exact=out)


def usable(table: DataFrame) -> DataFrame:
    """The rows that take part, with the label they are compared by; see ROW."""
    rows = table.select(F.col("vec_id").cast("long").alias("vid"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    moved = F.when(F.col("vid") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce("vid", F.lit(int(LONG.max))).alias("vid"),
        F.col("vid").isNull().alias("none"),
        moved.alias("label"),
        F.size("embedding").alias("width"),
        "embedding",
    )
    return rows.mapInPandas(_whole, ROW)


def unpacked(cells: pd.Series, width: int) -> np.ndarray:
    """Rows of integers of one width."""
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    sizes = cells.str.len()
    if sizes.min() == sizes.max():
        return np.frombuffer(b"".join(cells), kinds[int(sizes.iloc[0]) // width]).reshape(-1, width).astype(np.int64)
    return np.stack([np.frombuffer(c, kinds[len(c) // width]).astype(np.int64) for c in cells])


class Cells:
    """The cells of each dimension: inner cuts, and the least and greatest value of each cell."""

    def __init__(self, least: np.ndarray, most: np.ndarray, sample: np.ndarray | None):
        width = len(least)
        if sample is None or not len(sample):
            cuts = np.linspace(least.astype(float), most.astype(float), CELLS + 1)[1:-1].T
        else:
            cuts = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0).T
        self.cuts = np.ceil(cuts)  # (width, CELLS - 1); a cell begins at its cut
        self.lo = np.column_stack([least, np.maximum(self.cuts, least[:, None])]).astype(np.float64)
        self.hi = np.column_stack([np.minimum(self.cuts - 1, most[:, None]), most]).astype(np.float64)
        self.hi = np.maximum(self.lo, self.hi)  # an empty cell
        self.size = np.maximum(np.abs(least.astype(float)), np.abs(most.astype(float)))
        self.width = width

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The approximation: a byte holds two dimensions' cells."""
        cell = np.zeros((len(rows), self.width + self.width % 2), np.uint8)
        for i in range(self.width):
            cell[:, i] = np.searchsorted(self.cuts[i], rows[:, i], "right")
        return cell[:, 0::2] * np.uint8(CELLS) + cell[:, 1::2]

    def tables(self, anchors: np.ndarray, upper: bool) -> np.ndarray:
        """(bytes of a code, 256, anchors): what each byte adds to the bound, rounded outward as a whole."""
        a = anchors.astype(np.float64).T[:, None, :]
        both = a * self.lo[:, :, None], a * self.hi[:, :, None]
        bound = np.maximum(*both) if upper else np.minimum(*both)
        if self.width % 2:
            bound = np.concatenate([bound, np.zeros_like(bound[:1])])
        table = (bound[0::2, :, None, :] + bound[1::2, None, :, :]).reshape(len(bound) // 2, CELLS * CELLS, -1)
        mass = np.abs(anchors.astype(np.float64)) @ self.size
        kind = np.float32 if mass.max() < 1e30 else np.float64
        slack = (4 * self.width * float(np.finfo(kind).eps) * mass + 1e-9) / len(table)
        return (table + (slack if upper else -slack)).astype(kind)


def bounded(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(rows, anchors): the bound of each pair."""
    total = np.zeros((len(codes), table.shape[2]), table.dtype)
    held = np.empty_like(total)
    for j in range(len(table)):
        np.take(table[j], codes[:, j], axis=0, out=held)
        total += held
    return total


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows."""
    if float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1] < 2**52:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([min(max(int(s), LONG.min), LONG.max) for s in exact], np.int64)


class Best:
    """The best `k` rows of each of `slots` windows, and the score that a row must reach in each."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.held = [np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64)]  # slot, score, none, vid, uid
        self.needed = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, rows: pd.DataFrame) -> None:
        if not len(slot):
            return
        new = (slot, score, rows["none"].to_numpy(), rows["vid"].to_numpy(), rows["uid"].to_numpy())
        slot, score, none, vid, uid = (np.concatenate(p) for p in zip(self.held, new, strict=True))
        order = np.lexsort((uid, vid, none, ~score, slot))  # ~score: falling, without leaving the range of a long
        at = slot[order]
        first = np.searchsorted(at, at, "left")
        order = order[np.arange(len(at)) - first < self.k]
        self.held = [c[order] for c in (slot, score, none, vid, uid)]
        n = np.bincount(self.held[0], minlength=self.slots)
        full = np.flatnonzero(n == self.k)
        last = np.searchsorted(self.held[0], full, "right") - 1
        self.needed[full] = self.held[1][last]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("slot", "score", "none", "vid", "uid"), self.held, strict=True)))


def best_alike(anchors: pd.DataFrame, a: np.ndarray, rows: pd.DataFrame, x: np.ndarray, codes: np.ndarray, cells: Cells, best: Best) -> int:
    """The rows of each anchor's own label; the number of pairs scored."""
    done, labels = 0, rows["label"].to_numpy()
    for label, group in anchors.groupby("label", sort=False):
        mine = np.flatnonzero(labels == label)
        if not len(mine):
            continue
        for at in range(0, len(group), AT_ONCE):
            slot = group["slot"].to_numpy()[at : at + AT_ONCE]
            upper = bounded(codes[mine], cells.tables(a[slot], True))
            r, c = np.nonzero(upper >= best.needed[slot])
            r, s = mine[r], slot[c]
            other = rows["uid"].to_numpy()[r] != anchors["uid"].to_numpy()[s]
            r, s = r[other], s[other]
            for k in range(0, len(r), SCORED):
                i, j = r[k : k + SCORED], s[k : k + SCORED]
                best.add(j, scores(a[j], x[i]), rows.iloc[i])
            done += len(r)
    return done


def best_below(anchors: pd.DataFrame, a: np.ndarray, rows: pd.DataFrame, x: np.ndarray, codes: np.ndarray, cells: Cells, best: Best) -> int:
    """The rows of other labels in the window of each positive; the number of pairs scored."""
    done = 0
    tops = np.stack(anchors["tops"].to_numpy())  # (anchors, KEPT), missing ones as NaN
    for at in range(0, len(anchors), AT_ONCE):
        slot = np.arange(at, min(at + AT_ONCE, len(anchors)))
        top = tops[slot]
        upper = bounded(codes, cells.tables(a[slot], True))
        # the least that may enter any window: its floor, or what fills it by now
        need = np.maximum(np.ceil(0.8 * top - 1e-6 * np.abs(top) - 1), best.needed.reshape(-1, KEPT)[slot])
        r, c = np.nonzero((upper >= np.nanmin(need, axis=1)) & (rows["label"].to_numpy()[:, None] != anchors["label"].to_numpy()[slot]))
        lows = cells.tables(a[slot], False)
        for k in range(0, len(r), SCORED):
            i, j = r[k : k + SCORED], c[k : k + SCORED]
            low = lows[np.arange(lows.shape[0]), codes[i], j[:, None]].sum(axis=1)
            enters = (low[:, None] <= top[j] + 1) & (upper[i, j][:, None] >= need[j])
            some = enters.any(axis=1)
            i, j = i[some], j[some]
            score = scores(a[slot[j]], x[i])
            done += len(i)
            for p in range(KEPT):
                limit = anchors["scores"].to_numpy()
                exact = [(int(limit[slot[q]][p]) if len(limit[slot[q]]) > p else None) for q in range(len(slot))]
                floor = np.array([LONG.max if t is None else -(-80 * t // 100) for t in exact], np.int64)
                roof = np.array([LONG.min if t is None else t for t in exact], np.int64)
                inside = (score >= floor[j]) & (score <= roof[j])
                best.add(slot[j][inside] * KEPT + p, score[inside], rows.iloc[i[inside]])
    return done


def _mine(batches: Iterator[pd.DataFrame], cells: dict[int, Cells], below: bool) -> Iterator[pd.DataFrame]:
    """Rows in order of (chunk, split, side): a chunk's anchors, then the rows that they meet."""
    key, anchors, held, size, state = None, [], [], 0, {}

    def flush() -> None:
        nonlocal held, size
        if held and anchors and not state:
            everyone = pd.concat(anchors, ignore_index=True)
            for width, group in everyone.groupby("width"):
                group = group.reset_index(drop=True)
                group["slot"] = np.arange(len(group))
                if below:
                    group["tops"] = [np.array([*map(float, s)] + [np.nan] * (KEPT - len(s))) for s in group["scores"]]
                state[width] = (group, unpacked(group["exact"], width), Best(len(group) * (KEPT if below else 1), KEPT))
        if held and state:
            rows = pd.concat(held, ignore_index=True)
            for width, part in rows.groupby("width"):
                if width in state:
                    group, a, best = state[width]
                    part = part.reset_index(drop=True)
                    x = unpacked(part["exact"], width)
                    (best_below if below else best_alike)(group, a, part, x, cells[width].codes(x), cells[width], best)
        held, size = [], 0

    def emitted() -> Iterator[pd.DataFrame]:
        for group, _, best in state.values():
            out = best.rows()
            of = group.iloc[out["slot"] // (KEPT if below else 1)]
            out = out.assign(anchor=of["uid"].to_numpy(), place=out["slot"] % KEPT if below else 0)
            yield out[["anchor", "place", "score", "none", "vid", "uid"]]

    for pdf in batches:
        new = (pdf[["chunk", "split"]].diff() != 0).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)  # the first row of a batch always counts
        for start, stop in zip(starts, [*starts[1:], len(pdf)], strict=True):
            part = pdf.iloc[start:stop]
            now = (part["chunk"].iloc[0], part["split"].iloc[0])
            if now != key:
                flush()
                yield from emitted()
                key, anchors, state = now, [], {}
            side = part["side"].to_numpy()
            if (side == 0).any():
                anchors.append(part[side == 0])
            if (side == 1).any():
                held.append(part[side == 1])
                size += len(held[-1])
                if size >= BLOCK:
                    flush()
    flush()
    yield from emitted()


def _search(rows: DataFrame, anchors: DataFrame, chunks: int, cells: dict[int, Cells], below: bool) -> DataFrame:
    """anchor (uid), place, and score, none, vid, uid of the best rows of each split's windows."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # bounded by the vectors' width
    fields = [c.split()[0] for c in ROW.split(", ")] + ["scores"]
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int").alias("chunk")
    split = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(SPLITS)).cast("int").alias("split")
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = anchors.select(*fields, chunk, each(SPLITS, "split"), F.lit(0).alias("side"))
    met = rows.withColumn("scores", F.lit(None).cast("array<long>")).select(*fields, each(chunks, "chunk"), split, F.lit(1).alias("side"))
    both = asked.unionByName(met).repartition(min(chunks * SPLITS, 4096), "chunk", "split").sortWithinPartitions("chunk", "split", "side")
    return both.mapInPandas(lambda it: _mine(it, shared.value, below), "anchor long, place int, score long, none boolean, vid long, uid long")


def approximation(rows: DataFrame) -> dict[int, Cells]:
    """The cells for each width: limits over all rows, cuts from at most SAMPLE of them."""

    def limits(batches):
        for pdf in batches:
            for width, part in pdf.groupby("width"):
                x = unpacked(part["exact"], width)
                yield pd.DataFrame({"width": width, "dim": np.arange(width), "least": x.min(axis=0), "most": x.max(axis=0)})

    found = rows.select("width", "exact").mapInPandas(limits, "width int, dim int, least long, most long")
    found = found.groupBy("width", "dim").agg(F.min("least").alias("least"), F.max("most").alias("most")).toPandas()  # one row per dimension
    sample = rows.select("width", "exact", F.xxhash64("exact").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    out = {}
    for width, part in found.sort_values("dim").groupby("width"):
        mine = sample[sample["width"] == width]
        out[int(width)] = Cells(part["least"].to_numpy(), part["most"].to_numpy(), unpacked(mine["exact"], int(width)) if len(mine) else None)
    return out


def _first(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The first KEPT of each window: at most KEPT * SPLITS rows meet."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "none", "vid", "uid")
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= KEPT)


def _id(none: Column, vid: Column) -> Column:
    return F.when(~none, vid)


def mine(table: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the module."""
    rows = durable(usable(table))
    asked = rows.where(~F.col("none") & (F.col("vid") % 100 == 0))
    chunks = max(1, -(-asked.count() // ANCHORS))
    cells = approximation(rows)
    alike = _search(rows, asked.withColumn("scores", F.lit(None).cast("array<long>")), chunks, cells, below=False)
    positive = durable(_first(alike, ["anchor"], "number"))
    tops = positive.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("number", "score", "none", "vid"))).alias("p"))  # at most KEPT
    tops = tops.select(F.col("anchor").alias("uid"), "p", F.col("p.score").alias("scores"))
    having = durable(asked.join(tops, "uid"))
    below = _first(_search(rows, having.drop("p"), chunks, cells, below=True), ["anchor", "place"], "rank")
    named = having.select(F.col("uid").alias("anchor"), F.col("vid").alias("anchor_id"), F.posexplode("p").alias("place", "of"))
    out = below.join(named, ["anchor", "place"])
    return out.select(
        "anchor_id",
        _id(F.col("of.none"), F.col("of.vid")).alias("positive_id"),
        "rank",
        _id(F.col("none"), F.col("vid")).alias("negative_id"),
        F.col("of.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
