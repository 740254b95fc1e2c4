"""The nightly funnel as long metrics, series per forum, and the labels of the precision audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Statuses that passed verification, of these the truly new ones, and the metrics of a forum.
PASSED = ("verified", "import_ready", "imported", "import_failed", "crosscheck_dupe")
GOOD = ("verified", "import_ready", "imported")
FORUM_METRICS = ("good", "rejected", "processed", "extracted", "transient", "too_few")


def ratio(n: Column, d: Column, places: int = 3) -> Column:
    return F.when(d > 0, F.round(n / d, places)).otherwise(0.0)


def _judged(status: Column) -> Column:
    return F.coalesce(status, F.lit("pending")).isin("pending", "deferred", "") == F.lit(False)


def night_metrics(threads: DataFrame, cases: DataFrame) -> DataFrame:
    """(metric, value) of one night: counts, three ratios, and a row per reason met."""
    t = threads.agg(F.count_if(_judged(F.col("status"))).alias("threads_processed"), F.count_if(F.col("status") == "discarded").alias("threads_discarded"))
    c = cases.agg(F.count(F.lit(1)).alias("cases_extracted"), F.count_if(F.col("status").isin(*PASSED)).alias("cases_verified"), F.count_if(F.col("status") == "imported").alias("cases_imported"), F.count_if(F.col("status") == "verify_rejected").alias("verify_rejected"))
    one = t.crossJoin(F.broadcast(c))  # one row each
    one = one.withColumns({"yield_rate": ratio(F.col("cases_extracted"), F.col("threads_processed")), "verify_pass_rate": ratio(F.col("cases_verified"), F.col("cases_verified") + F.col("verify_rejected")), "import_rate": ratio(F.col("cases_imported"), F.col("cases_extracted"))})
    long = one.select(*(F.col(x).cast("double").alias(x) for x in one.columns)).unpivot([], one.columns, "metric", "value")
    by = lambda rows, prefix, key: rows.groupBy(F.concat(F.lit(prefix), key).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    discarded = by(threads.where("status = 'discarded'"), "discarded:", T.discard_bucket(F.col("discard_reason")))
    rejected = by(cases.where("status = 'verify_rejected'"), "verify_reject:", T.failing_condition(F.col("review_note")))
    return long.unionByName(discarded).unionByName(rejected)


def forum_night(threads: DataFrame, cases: DataFrame) -> DataFrame:
    """Six counts per forum seen in either table, zero where it lacks one."""
    transient = (F.coalesce("status", F.lit("")) == "error") | (T.discard_bucket(F.col("discard_reason")) == "transient")
    few = T.discard_bucket(F.col("discard_reason")) == "too_few_posts"
    t = threads.where("forum_id is not null").groupBy("forum_id").agg(F.count_if(~transient & _judged(F.col("status"))).alias("processed"), F.count_if(transient).alias("transient"), F.count_if(few).alias("too_few"))
    c = cases.where("forum_id is not null").groupBy("forum_id").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("status").isin(*GOOD)).alias("good"), F.count_if(F.col("status") == "verify_rejected").alias("rejected"))
    return t.join(c, "forum_id", "full").select("forum_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in FORUM_METRICS))


def night_start(now: Column, hour: int = 21, zone: str = "UTC") -> Column:
    """Start, in UTC, of the night that holds or last preceded `now` in local time."""
    local = F.from_utc_timestamp(now, zone) - F.make_interval(hours=F.lit(hour))
    return F.to_utc_timestamp(F.date_trunc("day", local) + F.make_interval(hours=F.lit(hour)), zone)


def degenerate(runs: DataFrame, threads: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: whether a night must not move metrics (stopped by a quota, or nothing done at all)."""
    r = runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.bool_or(F.coalesce("stop_reason", F.lit("")).rlike("(?i)quota|auth|limit")), F.lit(False)).alias("stopped"))
    sizes = r.crossJoin(F.broadcast(threads.agg(F.count(F.lit(1)).alias("t")))).crossJoin(F.broadcast(cases.agg(F.count(F.lit(1)).alias("c"))))  # one row each
    return sizes.select((F.col("stopped") | (F.col("runs") + F.col("t") + F.col("c") == 0)).alias("degenerate"), "stopped")


def overlay(history: DataFrame, tonight: DataFrame) -> DataFrame:
    """`history` (date, scope, metric, value) with tonight's points in place of any of its dates."""
    keys = ["date", "scope", "metric"]
    return history.join(tonight.select(*keys).distinct(), keys, "left_anti").unionByName(tonight)


def series(metrics: DataFrame, scope: str, metric: str, last: int) -> DataFrame:
    """The last points of one series, oldest first."""
    return metrics.where((F.col("scope") == scope) & (F.col("metric") == metric)).orderBy(F.desc("date")).limit(last).orderBy("date")


def latest_labels(labels: DataFrame) -> DataFrame:
    """The newest verdict of each case, by ts, else date; of equal ones the first."""
    order = F.struct(F.coalesce(F.col("ts").cast("string"), F.col("date").cast("string")).alias("t"), (-F.col("seq")).alias("s"))
    return labels.where(F.coalesce("case_id", F.lit("")) != "").groupBy("case_id").agg(F.max_by(F.struct(*[c for c in labels.columns if c != "case_id"]), order).alias("l")).select("case_id", "l.*")


def _accused(labels: DataFrame) -> DataFrame:
    clause = F.when(F.col("failed_condition").rlike("^[a-e]$"), F.col("failed_condition")).otherwise("none")
    return latest_labels(labels).where("wrongly_accepted").withColumn("clause", clause)


def failure_clusters(labels: DataFrame, most: int = 4) -> DataFrame:
    """Per clause of wrongly accepted final verdicts: count, sure ones, the first few reasons.

    The reasons are ranked first, which Spark cuts before the shuffle; `clause_members` has the cases.
    """
    final = _accused(labels)
    per = final.groupBy("clause").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("sure"), F.min("seq").alias("__first"))
    ranked = final.where("coalesce(reason, '') <> ''").withColumn("__n", F.row_number().over(Window.partitionBy("clause").orderBy("seq"))).where(F.col("__n") <= most)
    reasons = ranked.groupBy("clause").agg(F.array_sort(F.collect_list(F.struct("seq", "reason"))).alias("r")).select("clause", F.col("r.reason").alias("reasons"))
    met = per.join(reasons, "clause", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    return met.orderBy(F.desc("n"), "__first").drop("__first")


def clause_members(labels: DataFrame) -> DataFrame:
    """(clause, case_id) of wrongly accepted final verdicts."""
    return _accused(labels).select("clause", "case_id")


def pooled(labels: DataFrame, today: Column, days: int) -> DataFrame:
    """wrong and judged over the trailing days, the day `days` ago left out."""
    return labels.where(F.col("date") > F.date_sub(today, days)).agg(F.count_if(F.coalesce("wrongly_accepted", F.lit(False))).alias("wrong"), F.count(F.lit(1)).alias("judged"))


def precision_alert(today: DataFrame, pool: DataFrame, rate: float = 0.2, least: int = 3, least_judged: int = 5, pool_least: int = 5, cluster_least: int = 3) -> DataFrame:
    """One row of the alert decision from today's verdicts and the pooled counts."""
    judged = today.where(~F.coalesce("parse_fail", F.lit(False)) & ~F.coalesce("errored", F.lit(False)))
    counts = judged.agg(F.count(F.lit(1)).alias("judged"), F.count_if("wrongly_accepted").alias("wrong"), F.count_if(F.col("wrongly_accepted") & (F.col("confidence") == "high")).alias("sure"))
    clause = judged.where("wrongly_accepted and coalesce(failed_condition, 'none') <> 'none'").groupBy("failed_condition").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"))
    top = clause.agg(F.max_by("failed_condition", F.struct("n", (-F.col("s")).alias("s"))).alias("clause"), F.coalesce(F.max("n"), F.lit(0)).alias("clustered"))
    row = counts.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(pool.select(F.col("wrong").alias("pool_wrong"), F.col("judged").alias("pool_judged"))))  # one row each
    nudge = (F.col("wrong") >= least) & (F.col("judged") >= least_judged) & (ratio(F.col("wrong"), F.col("judged"), 9) >= rate)
    pooled_hit = (F.col("pool_wrong") >= pool_least) & (ratio(F.col("pool_wrong"), F.col("pool_judged"), 9) >= rate)
    row = row.withColumns({"nudge": nudge, "cluster_hit": nudge & (F.col("clustered") >= cluster_least), "pooled_hit": pooled_hit})
    return row.withColumn("alert", F.col("cluster_hit") | F.col("pooled_hit"))


#: What a case that passed its verdict may be by now; a failed import is neither.
PASS_LIKE = ("verified", "imported", "import_ready", "crosscheck_dupe")


def reject_rate(cases: DataFrame, since: Column) -> DataFrame:
    """Share of rejections among the verdicts on cases (status, created_at) made `since`; 0 without any."""
    recent = cases.where(F.col("created_at") >= since)
    counts = recent.agg(F.count_if(F.col("status") == "verify_rejected").alias("rejected"), F.count_if(F.col("status").isin(*PASS_LIKE)).alias("passed"))
    return counts.withColumn("rate", ratio(F.col("rejected"), F.col("rejected") + F.col("passed")))


def probe_metrics(probe: DataFrame) -> DataFrame:
    """Rates of a calibration probe (fetched, parsed, approved, extracted per thread) and its verdict."""
    sums = probe.agg(F.count(F.lit(1)).alias("threads"), *(F.count_if(c).alias(c) for c in ("parsed", "approved", "extracted")))
    rates = sums.withColumns({f"{c}_rate": ratio(F.col(c), F.col("threads"), 6) for c in ("parsed", "approved", "extracted")})
    return rates.withColumn("passes", (F.col("parsed_rate") >= 0.6) & (F.col("approved_rate") >= 0.1) & (F.col("extracted_rate") >= 0.05))


def guarded_recalibration(results: DataFrame, gain: float = 0.2) -> DataFrame:
    """Which candidate calibrations to keep: those that succeeded and beat the baseline by `gain`."""
    return results.withColumn("keep", F.coalesce(F.col("succeeded"), F.lit(False)) & (F.coalesce("candidate", F.lit(0.0)) >= F.coalesce("baseline", F.lit(0.0)) + gain))
