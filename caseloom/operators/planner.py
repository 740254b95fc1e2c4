"""The guarded nightly planner: one decision per forum from its last few nights.

All forums are planned in one job: windows of the last rows per forum, three CASE expressions, one
`coalesce` for precedence, and a breaker over all forums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import manifest

from .metrics import FORUM_METRICS


@dataclass(frozen=True)
class Limits:
    """Fixed values of the planner, all adjustable."""

    priority_nights: int = 3
    deadband: float = 5.0
    step: float = 15.0
    churn: float = 0.5
    least_processed: int = 20
    least_outcomes: int = 5
    cooldown_nights: int = 2
    short_hours: int = 24
    long_hours: int = 168
    shorten_good: int = 3
    shorten_yield: float = 0.20
    extend_processed: int = 10
    transient: float = 0.30
    lock_days: int = 10
    recal_processed: int = 30
    recal_transient: float = 0.20
    recal_too_few: float = 0.5
    stale_days: int = 21
    breaker: float = 0.50
    breaker_least: int = 4
    actions: int = 8


def aligned(metrics: DataFrame) -> DataFrame:
    """One row per (scope, date) with the six forum metrics; nights without `processed` don't count."""
    wide = metrics.where(F.col("metric").isin(*(f"forum_{m}" for m in FORUM_METRICS))).groupBy("scope", "date").pivot("metric", [f"forum_{m}" for m in FORUM_METRICS]).agg(F.first("value"))
    return wide.where("forum_processed is not null").select("scope", "date", *(F.coalesce(f"forum_{m}", F.lit(0.0)).alias(m) for m in FORUM_METRICS))


def smoothed(good: Column, processed: Column) -> Column:
    return (good + 1) / (processed + 10)


def windows(nights: DataFrame, today: Column, limits: Limits) -> DataFrame:
    """One row per scope: how many nights, and sums and extremes over its last two and three."""
    back = nights.withColumn("__n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("date"))))
    share = F.when(F.col("processed") + F.col("transient") > 0, F.col("transient") / (F.col("processed") + F.col("transient"))).otherwise(0.0)
    back = back.withColumn("share", share)
    out = [F.count(F.lit(1)).alias("nights"), (F.datediff(today, F.max("date")) > limits.stale_days).alias("stale")]
    for k in sorted({limits.cooldown_nights, limits.priority_nights, 2, 3}):
        inside = F.col("__n") <= k
        out += [F.sum(F.when(inside, F.col(m))).alias(f"{m}{k}") for m in FORUM_METRICS]
        out += [F.max(F.when(inside, F.col("share"))).alias(f"share{k}"), F.min(F.when(inside, F.col("good"))).alias(f"least_good{k}"), F.max(F.when(inside, F.col("good"))).alias(f"most_good{k}"), F.min(F.when(inside, F.col("processed"))).alias(f"least_processed{k}")]
    return back.groupBy("scope").agg(*out)


def plan(forums: DataFrame, nights: DataFrame, journal: DataFrame, now: Column, today: Column, limits: Limits = Limits()) -> DataFrame:
    """forum_id, knob, direction, strength, new values and whether applied, deferred or proposed.

    `journal`: forum_id, date, knob, direction of applied changes.  A forum changed today is out of
    play.  If more than half of the evaluable forums would change, none does.
    """
    L = limits
    w = windows(nights, today, L).withColumnRenamed("scope", "id")
    changed = journal.where(F.col("date") == today).select(F.col("forum_id").alias("id")).distinct()
    locks = journal.where((F.col("knob") == "cooldown") & (F.col("date") >= F.date_sub(today, L.lock_days))).groupBy(F.col("forum_id").alias("id")).agg(F.collect_set("direction").alias("locks"))
    f = forums.join(changed, "id", "left_anti").join(w, "id", "left").join(locks, "id", "left")
    f = f.withColumns({"nights": F.coalesce("nights", F.lit(0)), "locks": F.coalesce("locks", F.array().cast("array<string>"))})
    p, c = L.priority_nights, L.cooldown_nights
    fresh = ~F.coalesce("stale", F.lit(True))

    stuck = (F.col("calibration_status") == "calibrated") & ~F.col("status").isin("disqualified", "calibration_failed", "exhausted", "discovered", "queued")
    stuck = stuck & (F.col("nights") >= 3) & fresh & (F.col("processed3") >= L.recal_processed) & (F.col("extracted3") == 0) & (F.col("share3") < L.recal_transient) & (F.col("too_few3") <= L.recal_too_few * F.col("processed3"))

    parked = F.col("cooldown_tier_hours").isNotNull() & F.col("cooldown_set_at").isNotNull() & (F.col("status") != "exhausted") & (F.coalesce("new_threads_last_batch", F.lit(-1)) != 0)
    parked = parked & (F.col("nights") >= c) & fresh & (F.col(f"share{c}") < L.transient)
    shorten = (F.col("cooldown_tier_hours") == L.long_hours) & (F.col(f"least_good{c}") >= L.shorten_good) & (smoothed(F.col(f"good{c}"), F.col(f"processed{c}")) >= L.shorten_yield)
    extend = (F.col("cooldown_tier_hours") == L.short_hours) & (F.col(f"most_good{c}") == 0) & (F.col(f"least_processed{c}") >= L.extend_processed)
    until = lambda hours: now + F.make_interval(hours=F.lit(hours))
    shorten = shorten & ~F.array_contains("locks", "extend") & (until(L.short_hours) < F.col("cooldown_until"))
    extend = extend & ~F.array_contains("locks", "shorten") & (until(L.long_hours) > F.col("cooldown_until"))
    turn = F.when(parked & shorten, "shorten").when(parked & extend, "extend")

    eligible = F.col("status").isin("active", "exhausted", "queued") & (F.col("nights") >= p) & fresh & (F.col(f"share{p}") < L.transient) & (F.col(f"processed{p}") >= L.least_processed) & (F.col(f"good{p}") + F.col(f"rejected{p}") >= L.least_outcomes)
    current = F.coalesce("priority_score", F.lit(0.0))
    far = F.round(smoothed(F.col(f"good{p}"), F.col(f"processed{p}")) * 100, 1)
    near = F.round(smoothed(F.col("good2"), F.col("processed2")) * 100, 1)
    rising, falling = (far > current + L.deadband) & (near > current), (far < current - L.deadband) & (near < current)
    moved = current + F.least(F.greatest(far - current, F.lit(-L.step)), F.lit(L.step))
    score = F.round(F.least(F.greatest(moved, F.lit(0.0)), F.lit(100.0)), 1)
    shift = F.when(eligible & (rising | falling) & (F.abs(score - current) >= L.churn), F.when(rising, "up").otherwise("down"))

    def decision(knob, direction, strength, new_score=None, new_tier=None):
        return F.struct(F.lit(knob).alias("knob"), direction.alias("direction"), strength.alias("strength"), (F.lit(None).cast("double") if new_score is None else new_score).alias("priority_score"), (F.lit(None).cast("int") if new_tier is None else new_tier).alias("cooldown_tier_hours"))

    tier = F.when(turn == "shorten", L.short_hours).otherwise(L.long_hours)
    chosen = (
        F.when(stuck, decision("recalibrate_proposal", F.lit(None).cast("string"), F.lit(0.0)))
        .when(turn.isNotNull(), decision("cooldown", turn, F.lit(1000.0), new_tier=tier))
        .when(shift.isNotNull(), decision("priority", shift, F.abs(score - current), new_score=score))
    )
    decided = f.select(F.col("id").alias("forum_id"), "nights", chosen.alias("d"))
    is_change = F.col("d").isNotNull() & (F.col("d.knob") != "recalibrate_proposal")
    totals = decided.agg(F.count_if(F.col("nights") >= c).alias("evaluable"), F.count_if(is_change).alias("changes"))
    rows = decided.where("d is not null").crossJoin(F.broadcast(totals))  # one row
    tripped = (F.col("evaluable") >= L.breaker_least) & (F.col("changes") > L.breaker * F.col("evaluable"))
    rows = rows.select("forum_id", "d.*", tripped.alias("tripped"))
    ranked = rows.where("knob <> 'recalibrate_proposal'").orderBy(F.desc("strength"), "forum_id").limit(L.actions).select("forum_id", F.lit(True).alias("__in"))
    outcome = F.when(F.col("knob") == "recalibrate_proposal", "proposed").when(~F.col("tripped") & F.col("__in"), "applied").otherwise("deferred")
    return rows.join(ranked, "forum_id", "left").withColumn("outcome", outcome).drop("__in", "tripped")


def applied_with_journal(forums: DataFrame, plan: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(forums with applied values, journal rows that hold old and new values)."""
    due = plan.where("outcome = 'applied'").select(F.col("forum_id").alias("id"), "knob", "direction", F.col("priority_score").alias("__p"), F.col("cooldown_tier_hours").alias("__t"))
    met = forums.join(due, "id", "left")
    journal = met.where("knob is not null").select(F.col("id").alias("forum_id"), today.alias("date"), "knob", "direction", F.col("priority_score").alias("old_priority"), F.coalesce("__p", "priority_score").alias("new_priority"), F.col("cooldown_tier_hours").alias("old_tier"), F.coalesce("__t", "cooldown_tier_hours").alias("new_tier"))
    changed = met.withColumns({"priority_score": F.coalesce("__p", "priority_score"), "cooldown_tier_hours": F.coalesce("__t", "cooldown_tier_hours")}).select(*forums.columns)
    return changed, journal


def reverted(forums: DataFrame, journal: DataFrame) -> DataFrame:
    """`forums` with journaled changes undone where the row still holds what was written."""
    j = journal.select(F.col("forum_id").alias("id"), "old_priority", "new_priority", "old_tier", "new_tier")
    met = forums.join(j, "id", "left")
    held = F.col("priority_score").eqNullSafe(F.col("new_priority")) & F.col("cooldown_tier_hours").eqNullSafe(F.col("new_tier")) & (F.col("new_priority").isNotNull() | F.col("new_tier").isNotNull())
    back = {"priority_score": F.when(held, F.col("old_priority")).otherwise(F.col("priority_score")), "cooldown_tier_hours": F.when(held, F.col("old_tier")).otherwise(F.col("cooldown_tier_hours"))}
    return met.withColumns(back).select(*forums.columns)


#: What a forum may be to be worked on; how long a mined archive rests.
OPEN = ("discovered", "queued", "active", "exhausted")
REST_HOURS = 720


def rest_rule(forums: DataFrame, now: Column, hours: int = REST_HOURS) -> DataFrame:
    """`forums` after a walk: a whole archive with nothing pending is exhausted and cools down, any other is active.

    Sets status, cooldown_until, cooldown_tier_hours and cooldown_set_at.
    """
    done = F.coalesce("archive_complete", F.lit(False)) & (F.coalesce("pending", F.lit(0)) == 0)
    return forums.withColumns(
        {
            "status": F.when(done, "exhausted").otherwise("active"),
            "cooldown_until": F.when(done, now + F.make_dt_interval(hours=F.lit(hours))),
            "cooldown_tier_hours": F.when(done, hours),
            "cooldown_set_at": F.when(done, now),
        }
    )


def archive_cursor(cursors: DataFrame, visits: DataFrame) -> DataFrame:
    """Cursors (section, next_page, done) after visits (section, page, outcome): errors keep their page."""
    last = visits.groupBy("section").agg(F.max(F.when(F.col("outcome") == "ok", F.col("page"))).alias("ok"), F.coalesce(F.bool_or(F.col("outcome") == "end"), F.lit(False)).alias("ended"), F.min(F.when(F.col("outcome") == "error", F.col("page"))).alias("failed"))
    met = cursors.join(last, "section", "left")
    nxt = F.coalesce("failed", F.col("ok") + 1, "next_page")
    return met.select("section", nxt.alias("next_page"), (F.col("done") | F.coalesce("ended", F.lit(False)) & F.col("failed").isNull()).alias("done"))


def _free(forums: DataFrame, now: Column) -> DataFrame:
    return forums.where(F.col("status").isin(*OPEN) & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") < now)))


def forum_queue(forums: DataFrame, now: Column, most: int | None = 50) -> DataFrame:
    """Open forums that are not cooling down: never crawled first, then priority, then the longest wait; `most` of them, or all."""
    order = [F.col("last_crawled_at").isNotNull(), F.coalesce("priority_score", F.lit(0.0)).desc(), F.col("last_crawled_at").asc_nulls_first(), F.col("id")]
    queue = _free(forums, now).orderBy(*order)
    return queue if most is None else queue.limit(most)


def placed(queue: DataFrame, path: str) -> DataFrame:
    """A sorted `queue` of any length with the place of each row; it is kept at `path`.

    Sorted partitions are numbered on their own and written; each then starts behind the rows of those before it, so that
    only one row per partition meets in one task.
    """
    queue.withColumn("__k", F.monotonically_increasing_id()).write.parquet(path)
    rows = queue.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__k", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn("place", F.col("__start") + F.col("__k").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__start", "__k")


def calibration_queue(forums: DataFrame, now: Column, most: int = 10) -> DataFrame:
    """Open, free forums whose calibration is pending: fewest attempts first, then the oldest; `most` of them."""
    pending = F.coalesce("calibration_status", F.lit("pending")) == "pending"
    return _free(forums, now).where(pending).orderBy(F.coalesce("calibration_attempts", F.lit(0)), F.col("created_at").asc_nulls_first(), "id").limit(most)


def retry_queue(threads: DataFrame, fresh: str, failed: str, attempts: int) -> DataFrame:
    """Fresh rows before those that may be tried again, oldest first."""
    due = (F.col("status") == fresh) | ((F.col("status") == failed) & (F.coalesce("attempts", F.lit(0)) < attempts))
    return threads.where(due).orderBy(F.when(F.col("status") == fresh, 0).otherwise(1), "created_at", "id")


def next_brand(brands: DataFrame) -> DataFrame:
    """The brand (make, status, supported_rows) to work on, if one is left; see `manifest.queue`."""
    return manifest.queue(brands).limit(1)
