"""Review lists, coverage of the taxonomy, enrichment and recovery of discarded threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from . import faults

#: Reasons that no second look changes, and hosts whose word counts for nothing by itself.
TERMINAL = r"(?i)forum rules|rules page|\badvertisement\b|\bspam\b|for sale\b|classified ad|sticky (?:thread|post)|pinned (?:thread|post)|table of contents|index thread|request for a (?:service|repair|owner.?s?) manual|service manual, not|manual request|tool recommendation"
NOT_AUTHORITATIVE = r"(?i)(forum|forums|klub|club|\bbbs\b|reddit|quora|blogspot|wordpress|medium\.com|pinterest|facebook|fb\.com|twitter|x\.com|youtube|tiktok|instagram|bazos|bazar|autobazar|sauto|inzer|mobile\.de|autoscout|gumtree|craigslist|ebay|marktplaats)"
REVIEW_MOST = 500


def with_owner(cases: DataFrame, users: DataFrame) -> DataFrame:
    """Cases with the e-mail of who entered them, null for a row without a user."""
    return cases.join(users.select(F.col("id").alias("__user"), F.col("email").alias("user_email")), F.col("user_id") == F.col("__user"), "left").drop("__user")


def review_list(cases: DataFrame, most: int) -> DataFrame:
    """The newest cases by closing time."""
    return cases.orderBy(F.desc_nulls_last("closed_at"), "id").limit(min(most, REVIEW_MOST))


def latest_report(reports: DataFrame) -> DataFrame:
    """The row of the latest date."""
    return reports.orderBy(F.desc("date"), "id").limit(1)


def cases_per_forum(cases: DataFrame, threads: DataFrame) -> DataFrame:
    return cases.join(threads.select(F.col("id").alias("thread_id"), "forum_id"), "thread_id").groupBy("forum_id").agg(F.count(F.lit(1)).alias("n"))


def cases_in_window(cases: DataFrame, threads: DataFrame, start: Column, end: Column) -> DataFrame:
    """Cases of a time window with their thread's forum, null for a case without a thread."""
    inside = cases.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    return inside.join(threads.select(F.col("id").alias("thread_id"), "forum_id"), "thread_id", "left")


def coverage(cases: DataFrame) -> DataFrame:
    """One row: approved cases, how many have a fault, the catch-all fault, and a generation."""
    fault = F.col("canonical_fault_id")
    known = F.coalesce(F.col("model_gen"), F.col("model_year"), F.col("vehicle_generation")).isNotNull()
    return cases.where("status = 'approved'").agg(F.count(F.lit(1)).alias("total"), F.count_if(fault.isNotNull()).alias("classified"), F.count_if(fault == "other").alias("other"), F.count_if(known).alias("gen_known"))


def gap_histogram(cases: DataFrame) -> DataFrame:
    """Cases without a known generation by brand and model family, most first."""
    open_rows = cases.where("model_gen is null and model_year is null and vehicle_generation is null")
    return open_rows.groupBy(F.col("vehicle_brand").alias("brand"), F.col("model_base").alias("family")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "brand", "family")


def independent_domains(sources: DataFrame) -> DataFrame:
    """(id, domains) of each id's sources (id, url, is_forum): distinct hosts whose word counts."""
    host = U.domain(F.col("url"))
    good = sources.where(~F.coalesce("is_forum", F.lit(False))).select("id", host.alias("host")).where(F.col("host").isNotNull() & (F.col("host") != "") & ~F.col("host").rlike(NOT_AUTHORITATIVE))
    return good.groupBy("id").agg(F.array_sort(F.collect_set("host")).alias("domains"))


def discard_class(reason: Column) -> Column:
    r = F.trim(F.coalesce(reason, F.lit("")))
    return F.when(r == "", "other").when(r.rlike("(?i)too few posts"), "too_few").when(r.rlike(TERMINAL), "terminal").otherwise("recoverable")


def recoverable(threads: DataFrame, with_too_few: bool = False, forum: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(threads to look at again in order of seq, all of the forum's threads by class)."""
    rows = threads.withColumn("class", discard_class(F.col("discard_reason")))
    rows = rows.where(F.col("forum_id") == forum) if forum else rows
    wanted = rows.where(F.col("class").isin("recoverable", *(["too_few"] if with_too_few else [])))
    return (wanted.orderBy("seq").limit(most) if most else wanted), rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def enriched(questions: DataFrame, answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each (query_id, brand_group, code) with the number of answers found and its code's entry."""
    n = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("answers"))
    entry = faults.lookup_codes(dictionary, questions).select("asked_code", "asked_group", "description")
    met = questions.join(n, "query_id", "left").join(entry, (F.upper("code") == F.col("asked_code")) & F.col("brand_group").eqNullSafe(F.col("asked_group")), "left")
    return met.select("query_id", F.coalesce("answers", F.lit(0)).alias("answers"), F.col("description").alias("code_description"))


def section_text(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """The text of each asked section, by id, else by manual and title; one row per question, found or not."""
    by_id = asked.where("section_id is not null").join(sections, F.col("section_id") == F.col("id"), "left")
    named = asked.where("section_id is null").join(sections, (F.col("asked_manual") == F.col("manual")) & (F.col("asked_title") == F.col("title")), "left")
    met = by_id.unionByName(named)
    first = Window.partitionBy("query_id").orderBy(F.col("id").asc_nulls_last())
    return met.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def token_totals(usage: DataFrame, key: str) -> DataFrame:
    """Sums of input and output tokens, and of both."""
    both = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return usage.groupBy(key).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(both).alias("total_tokens"))


def once_a_day(now: Column, last: Column, start: int = 5, end: int = 9) -> Column:
    """Whether a daily job may run: within the closed window of hours, not yet today."""
    hour = F.hour(now)
    return (hour >= start) & (hour < end) & ~F.coalesce(last == F.to_date(now), F.lit(False))


def may_advance(pending: Column, batch: Column) -> Column:
    """Whether to read on: only while the backlog is below twice a batch, or twenty."""
    return F.coalesce(pending, F.lit(0)) < F.greatest(batch * 2, F.lit(20))
