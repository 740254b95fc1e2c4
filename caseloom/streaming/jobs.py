"""Streams by windows, idempotent metric writes, lifecycles; those with state and timers are in `stateful`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks

#: Which status may follow which in a case's life.
NEXT = {
    "ai_approved": ("verified", "verify_rejected", "verify_error"),
    "verify_error": ("verified", "verify_rejected", "verify_skipped"),
    "verified": ("import_ready", "crosscheck_dupe", "crosscheck_error", "quarantined"),
    "crosscheck_error": ("import_ready", "crosscheck_dupe"),
    "import_ready": ("imported", "import_failed", "quarantined"),
    "import_failed": ("imported",),
    "imported": ("quarantined",),
}


def settled(threads: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Batch form: `threads` (last_activity) with status and revisit_after by age.

    Quiet for `days` or of unknown or future date: to be processed now; else deferred until then.
    """
    due = F.col("last_activity") + F.make_interval(days=F.lit(days))
    young = F.col("last_activity").isNotNull() & (F.col("last_activity") <= now) & (due > now)
    return threads.withColumn("decision", F.when(young, "deferred").otherwise("process")).withColumn("revisit_after", F.when(young, due))


def revived(threads: DataFrame, now: Column) -> DataFrame:
    """Deferred threads whose time has come, back to pending."""
    due = (F.col("status") == "deferred") & (F.col("revisit_after").isNull() | (F.col("revisit_after") <= now))
    return threads.withColumn("status", F.when(due, "pending").otherwise(F.col("status")))


def nightly(events: DataFrame, at: str, keys: list[str], values: dict[str, Column], hour: int = 21, late: str = "1 day") -> DataFrame:
    """Sums per night that begins at `hour` UTC; works on batches and, by watermark, on streams."""
    night = F.window(at, "1 day", "1 day", f"{hour} hours")
    rows = events.withWatermark(at, late) if events.isStreaming else events
    sums = rows.groupBy(night.alias("night"), *keys).agg(*(F.sum(v).alias(n) for n, v in values.items()))
    return sums.select(F.to_date(F.col("night.start")).alias("date"), *keys, *values)


def call_counts(calls: DataFrame, at: str = "created_at", hours: int = 24, slide: str = "1 hour", most: int = 50) -> DataFrame:
    """Calls per user in sliding windows, and whether a window is over the limit."""
    rows = calls.withWatermark(at, slide) if calls.isStreaming else calls
    counts = rows.groupBy(F.window(at, f"{hours} hours", slide).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("calls"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "calls", (F.col("calls") > most).alias("over"))


def metric_writer(table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: metrics are upserted by (date, scope, metric), so a replay changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        keys = ["date", "scope", "metric"]
        rows = batch.dropDuplicates(keys)
        sinks.write_version(sinks.upsert(sinks.read_current(batch.sparkSession, table), rows, keys) if sinks.has_version(batch.sparkSession, table) else rows, table)

    return write


def transitions(cases: DataFrame, wanted: DataFrame, chunk: int = 4096) -> DataFrame:
    """`cases` (id, status) after wanted changes (id, seq, status) that the table of moves allows.

    The changes of a case are walked in order of seq; a move that is not allowed is passed over.
    What a run of changes does is a map from every status to a status, and maps compose: each `chunk`
    of a case's changes becomes such a map in a task of its own, and only maps meet per case.
    """
    moves = F.create_map(*(x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    allowed = lambda s, to: F.coalesce(F.array_contains(F.try_element_at(moves, s), to), F.lit(False))
    # a case with many changes is numbered within ranges of seq, so that no task sorts all of them
    sizes = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.lit(1))
    width = F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / parts), F.lit(1))
    ranged = wanted.join(sizes, "id").withColumn("part", F.floor((F.col("seq") - F.col("low")) / width))
    steps = ranged.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("status").alias("to")))).alias("steps"))
    states = [*NEXT]
    walk = lambda start: F.aggregate("steps", start, lambda s, x: F.when(allowed(s, x["to"]), x["to"]).otherwise(s))
    maps = steps.select("id", "part", F.create_map(*(x for s in states for x in (F.lit(s), walk(F.lit(s))))).alias("m"))
    chain = maps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", F.map_entries("m").alias("m")))).alias("chain"))
    met = cases.join(chain, "id", "left")
    last = F.aggregate("chain", F.col("status"), lambda s, x: F.coalesce(F.try_element_at(F.map_from_entries(x["m"]), s), s))
    return met.withColumn("status", F.coalesce(last, F.col("status"))).select(*cases.columns)


def repeats_dropped(events: DataFrame, id: str, at: str, late: str = "1 day") -> DataFrame:
    """Each id once, remembered as long as late rows may come."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id]) if events.isStreaming else events.dropDuplicates([id])
