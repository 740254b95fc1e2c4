"""Streams with state of several variables, timers and expiry, each with the batch form that it equals.

Rows are decided upon when the watermark has passed them: by then no row before them can come, so the answer is that
of the whole table, whatever the order of arrival.  Rows later than the watermark are dropped, rows repeated within it
count once.  A stream needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) and a
checkpoint, from which it resumes after it was lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .jobs import NEXT

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Microseconds of an hour.
HOUR = 3_600_000_000


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


class _Ordered(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, each id once, then takes them in order of time and id.

    A timer stands at each time that has rows; `take` sees one row at a time.
    """

    payload: StructType  # of a row besides its id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", _struct(("at", LongType()), ("id", LongType())), self.payload)
        self.seen = handle.getMapState("seen", _struct(("id", LongType())), _struct(("at", LongType())))
        self.swept = handle.getValueState("swept", _struct(("until", LongType())))
        self.more(handle)

    def more(self, handle: StatefulProcessorHandle) -> None:
        """Further variables."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in self.payload.fields]
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                if self.seen.containsKey((int(row.id),)):
                    continue
                self.seen.updateValue((int(row.id),), (int(row.at),))
                self.held.updateValue((int(row.at), int(row.id)), tuple(getattr(row, n) for n in names))
                self.handle.registerTimer(-(-int(row.at) // 1000) + 1)  # the millisecond behind it
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(k for k in self.held.keys() if k[0] < until)
        out = []
        for at, id in due:
            out += self.take(key[0], at, id, self.held.getValue((at, id)))
            self.held.removeKey((at, id))
        self.forget(until)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    columns: list[str]

    def take(self, key, at: int, id: int, payload) -> list[tuple]:
        raise NotImplementedError

    def forget(self, until: int) -> None:
        """Drop what can matter no more, now and then."""
        if self.swept.exists() and self.swept.get()[0] > until - self.keeps // 4:
            return
        self.swept.update((until,))
        for id, value in list(self.seen.iterator()):
            if value[0] < until - self.keeps:
                self.seen.removeKey(id)

    keeps = 48 * HOUR  # an id is remembered so long behind the watermark

    def close(self) -> None:
        pass


class _Limit(_Ordered):
    payload = _struct(("none", IntegerType()))
    columns = ["user_id", "id", "at", "recent"]

    def __init__(self, hours: int):
        self.hours = hours

    def more(self, handle) -> None:
        self.calls = handle.getMapState("calls", _struct(("at", LongType())), _struct(("n", LongType())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(k for k in self.held.keys() if k[0] < until)
        for at, _ in due:  # calls of one moment count for each other
            before = self.calls.getValue((at,))[0] if self.calls.containsKey((at,)) else 0
            self.calls.updateValue((at,), (before + 1,))
        counts = {k[0]: v[0] for k, v in list(self.calls.iterator())}
        out = []
        for at, id in due:
            out.append((key[0], id, at, sum(n for t, n in counts.items() if at - self.hours * HOUR <= t <= at)))
            self.held.removeKey((at, id))
        for t in counts:
            if t < until - self.hours * HOUR - 1000:
                self.calls.removeKey((t,))
        self.forget(until)
        if out:
            yield pd.DataFrame(out, columns=self.columns)


class _Life(_Ordered):
    payload = _struct(("to", StringType()))
    columns = ["case_id", "id", "at", "status", "moved"]

    def __init__(self, start: str):
        self.start = start

    def more(self, handle) -> None:
        self.status = handle.getValueState("status", _struct(("status", StringType())))

    def take(self, key, at, id, payload) -> list[tuple]:
        now = self.status.get()[0] if self.status.exists() else self.start
        moved = payload[0] in NEXT.get(now, ())
        if moved:
            now = payload[0]
            self.status.update((now,))
        return [(key, id, at, now, moved)]


class _Quiet(StatefulProcessor):
    """Holds a key's times that no later one has followed within `days`, with a timer for each."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", _struct(("at", LongType())), _struct(("n", LongType())))

    def _due(self, at: int) -> int:
        return -(-at // 1000) + self.days * 86_400_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0] for k in self.open.keys()}
        times = sorted(before.union(*(map(int, pdf["at"]) for pdf in rows)))
        span = self.days * 24 * HOUR
        kept = {a for a, b in zip(times, [*times[1:], None], strict=True) if b is None or b >= a + span}
        for at in before - kept:
            self.open.removeKey((at,))
            self.handle.deleteTimer(self._due(at))
        for at in kept - before:
            self.open.updateValue((at,), (1,))
            self.handle.registerTimer(self._due(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(k[0] for k in self.open.keys() if self._due(k[0]) <= expiredTimerInfo.getExpiryTimeInMs())
        for at in due:
            self.open.removeKey((at,))
        if due:
            yield pd.DataFrame({"id": [key[0]] * len(due), "at": due})

    def close(self) -> None:
        pass


def _moment(at: str) -> Column:
    return F.timestamp_micros(F.col(at))


def limited(calls: DataFrame, hours: int = 24, most: int = 50, late: str = "1 hour") -> DataFrame:
    """user_id, id, created_at, recent and over of each call (id, user_id, created_at): its user's calls in the hours up to it.

    A stream gives each call once the watermark has passed it; calls of one id count once.
    """
    rows = calls.select(F.col("id").cast("long").alias("id"), F.col("user_id").cast("string").alias("user_id"), "created_at", F.unix_micros("created_at").alias("at"), F.lit(0).alias("none"))
    if calls.isStreaming:
        counted = rows.withWatermark("created_at", late).groupBy("user_id").transformWithStateInPandas(_Limit(hours), "user_id string, id long, at long, recent long", "Append", "EventTime")
    else:
        trailing = Window.partitionBy("user_id").orderBy("at").rangeBetween(-hours * HOUR, 0)
        counted = rows.dropDuplicates(["user_id", "id"]).withColumn("recent", F.count(F.lit(1)).over(trailing))
    return counted.select("user_id", "id", _moment("at").alias("created_at"), "recent", (F.col("recent") > most).alias("over"))


def lives(changes: DataFrame, start: str = "ai_approved", late: str = "1 hour") -> DataFrame:
    """case_id, id, changed_at, status and moved after each wanted change (id, case_id, to, changed_at), in order of time and id.

    A change that the table of moves does not allow is passed over.  Batch form: the changes of a case are folded as an
    array, so a case must fit a task there; the stream holds a status and what the watermark has not passed.
    """
    rows = changes.select(F.col("id").cast("long").alias("id"), F.col("case_id").cast("string").alias("case_id"), "to", "changed_at", F.unix_micros("changed_at").alias("at"))
    if changes.isStreaming:
        done = rows.withWatermark("changed_at", late).groupBy("case_id").transformWithStateInPandas(_Life(start), "case_id string, id long, at long, status string, moved boolean", "Append", "EventTime")
    else:
        moves = F.create_map(*(x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        steps = rows.dropDuplicates(["case_id", "id"]).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "to"))).alias("steps"))
        none = F.array().cast("array<struct<id: bigint, at: bigint, status: string, moved: boolean>>")

        def step(acc: Column, s: Column) -> Column:
            now = F.when(F.size(acc) > 0, F.element_at(acc, -1)["status"]).otherwise(start)
            moved = F.coalesce(F.array_contains(F.try_element_at(moves, now), s["to"]), F.lit(False))
            return F.concat(acc, F.array(F.struct(s["id"].alias("id"), s["at"].alias("at"), F.when(moved, s["to"]).otherwise(now).alias("status"), moved.alias("moved"))))

        done = steps.select("case_id", F.inline(F.aggregate("steps", none, step)))
    return done.select("case_id", "id", _moment("at").alias("changed_at"), "status", "moved")


def quiet(threads: DataFrame, days: int = 365, late: str = "1 day", until: Column | None = None) -> DataFrame:
    """id and last_activity of each thread (id, last_activity) whenever it has been quiet for `days`.

    A batch gives what had become quiet by `until`, once for each stretch of activity; so does a stream by its watermark.
    """
    rows = threads.select(F.col("id").cast("string").alias("id"), "last_activity", F.unix_micros("last_activity").alias("at"))
    if threads.isStreaming:
        out = rows.withWatermark("last_activity", late).groupBy("id").transformWithStateInPandas(_Quiet(days), "id string, at long", "Append", "EventTime")
    else:
        following = F.lead("at").over(Window.partitionBy("id").orderBy("at"))
        due = F.col("at") + days * 24 * HOUR
        end = F.unix_micros(until) if until is not None else F.lit(None).cast("long")
        out = rows.select("id", "at").distinct().withColumn("next", following).where(F.coalesce(F.col("next") >= due, F.lit(True)) & F.coalesce(due <= end, F.lit(True)))
    return out.select("id", _moment("at").alias("last_activity"))
