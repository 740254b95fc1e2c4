"""Dashboard aggregations.  `now`, `since` and exclusions are parameters; every top-k has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without(rows: DataFrame, email: str, exclude: Sequence[str]) -> DataFrame:
    """Rows less those of excluded addresses; unknown addresses stay, an empty list excludes none."""
    return rows.where(F.col(email).isNull() | ~F.col(email).isin(*exclude)) if exclude else rows


def usage_by_user(usage: DataFrame, users: DataFrame, since: Column, exclude: Sequence[str] = ()) -> DataFrame:
    known = users.select(F.col("id").alias("user_id"), "email")
    return without(usage.where(F.col("created_at") >= since).join(known, "user_id", "left"), "email", exclude)


def ai_daily(usage: DataFrame, users: DataFrame, since: Column, exclude: Sequence[str] = ()) -> DataFrame:
    """Calls, tokens and users per UTC day."""
    rows = usage_by_user(usage, users, since, exclude)
    tokens = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")]
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("calls"), *tokens, F.countDistinct("user_id").alias("users")).orderBy("day")


def sessions_daily(sessions: DataFrame, users: DataFrame, since: Column, exclude: Sequence[str] = ()) -> DataFrame:
    """Sessions touched, of these created, and users per day of the last update."""
    rows = without(sessions.where(F.col("updated_at") >= since).join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left"), "email", exclude)
    day = F.to_date("updated_at")
    return rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.to_date("created_at") == day).alias("created"), F.countDistinct("user_id").alias("users")).orderBy("day")


def case_stats(cases: DataFrame, statuses: Sequence[str] = ("pending", "approved", "rejected")) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in statuses))


def registered_users(users: DataFrame, now: Column, exclude: Sequence[str] = ()) -> DataFrame:
    """All users, and those registered today and in the last 7 and 30 days."""
    rows = without(users, "email", exclude)
    at = F.col("created_at")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.to_date(at) == F.to_date(now)).alias("today"), F.count_if(at >= now - F.expr("INTERVAL 7 DAYS")).alias("week"), F.count_if(at >= now - F.expr("INTERVAL 30 DAYS")).alias("month"))


def top_users(usage: DataFrame, users: DataFrame, since: Column, limit: int = 20, exclude: Sequence[str] = ()) -> DataFrame:
    """Heaviest users by tokens; unknown ones go by their id.  Aggregated before the join."""
    sums = usage.where(F.col("created_at") >= since).groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")))
    named = without(sums.join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left"), "email", exclude)
    named = named.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("email", F.coalesce("email", F.col("user_id").cast("string")))
    return named.orderBy(F.desc("total_tokens"), "user_id").limit(limit)


def brand_stats(sessions: DataFrame, cases: DataFrame, since: Column, limit: int = 20) -> DataFrame:
    """Sessions (brand inside their JSON) and closed cases per brand, zero where one side lacks it."""
    brand = F.get_json_object("data", "$.vehicle.brand")
    a = sessions.where(F.col("updated_at") >= since).withColumn("brand", brand).where("brand is not null and brand <> ''").groupBy("brand").agg(F.count(F.lit(1)).alias("sessions"))
    b = cases.where(F.col("closed_at") >= since).where("vehicle_brand is not null and vehicle_brand <> ''").groupBy(F.col("vehicle_brand").alias("brand")).agg(F.count(F.lit(1)).alias("cases"))
    both = a.join(b, "brand", "full").select("brand", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "cases")))
    return both.orderBy(F.desc("sessions"), F.desc("cases"), "brand").limit(limit)


def histogram(rows: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least) if least else out


def percent_of_most(rows: DataFrame, value: str) -> DataFrame:
    """A small result with each value as per cent of the largest."""
    top = rows.agg(F.max(value).alias("__top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("percent", F.round(F.col(value) / F.col("__top") * 100).cast("long")).drop("__top")  # one row


def rate_limited(usage: DataFrame, hours: int = 24, most: int = 50) -> DataFrame:
    """Each call with the number of its user's calls in the trailing hours, and whether it was over."""
    at = F.unix_micros("created_at")
    trailing = Window.partitionBy("user_id").orderBy("__at").rangeBetween(-hours * 3_600_000_000, 0)
    return usage.withColumn("__at", at).withColumn("recent", F.count(F.lit(1)).over(trailing)).withColumn("over", F.col("recent") > most).drop("__at")


def source_kinds(urls: DataFrame, url: str = "thread_url") -> DataFrame:
    """Counts per kind and host of where rows come from."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    kind = F.when(F.coalesce(url, F.lit("")) == "", "none").when(F.contains(url, F.lit("/odi/tsbs/")), "bulletin").when(host.isNull(), "bad").otherwise("forum")
    return urls.select(kind.alias("kind"), F.coalesce(host, F.lit("")).alias("host")).groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n"))


def crawled_index(cases: DataFrame) -> DataFrame:
    """Distinct threads per (host, section) and distinct bulletins, in one pass."""
    host = F.regexp_replace(F.lower(F.try_parse_url("thread_url", F.lit("HOST"))), r"^www\.", "")
    section = F.regexp_extract(F.try_parse_url("thread_url", F.lit("PATH")), "^/([^/]+)", 1)
    number = F.regexp_extract("source_ref", r"(?i)NHTSA\s+(\d+)", 1)
    rows = cases.select(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(section, F.lit("")).alias("section"), F.when(host.isNotNull(), F.col("thread_url")).alias("url"), F.nullif(number, F.lit("")).alias("number"))
    return rows.groupBy("host", "section").agg(F.countDistinct("url").alias("threads"), F.countDistinct("number").alias("bulletins"), F.count_if(F.col("url").isNull() & F.col("number").isNull()).alias("unindexable"))


#: What fills a repair's place, and the brand that a forum's cases should have.
FILLER = r"(?iu)\b(viz výše|see above|n/a|none|unknown|nevím|tbd|xxx)\b"
FORUM_BRANDS = {"fordtransit.org": "ford", "skoda-club.net": "škoda|skoda", "kia-club.org": "kia", "club-fiat.com": "fiat"}


def audit_flags(cases: DataFrame) -> DataFrame:
    """`cases` (vehicle_brand, vehicle_model, symptoms, description, resolution, obd_codes, thread_url) with their flags."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    plain = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    about, fix, brand = text("description"), text("resolution"), text("vehicle_brand")
    host = F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(F.col("thread_url"), F.lit("HOST"))), r"^www\.", ""), F.lit(""))
    other = F.lit(False)
    for name, expected in FORUM_BRANDS.items():
        other = other | ((host == name) & (F.coalesce("vehicle_brand", F.lit("")) != "") & ~brand.rlike(f"(?iu){expected}"))
    length = F.length(fix)
    rules = {
        "no_brand": brand == "",
        "no_model": text("vehicle_model") == "",
        "no_problem_stated": (F.coalesce(F.size("symptoms"), F.lit(0)) <= 0) & (about == ""),
        "no_resolution": fix == "",
        "resolution_too_short": (fix != "") & (length < 10),
        "resolution_too_long": length > 400,
        "resolution_equals_description": (fix != "") & (about != "") & (plain(fix) == plain(about)),
        "resolution_filler": fix.rlike(FILLER) & (length < 25),
        "obd_malformed": F.exists(F.coalesce("obd_codes", F.array().cast("array<string>")), lambda c: (c != "") & ~F.trim(c).rlike("(?i)^[PCBU][0-9][0-9A-F]{3}$")),
        "brand_forum_mismatch": other,
    }
    return cases.withColumn("flags", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))))


def flags(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows per flag, one row of flagged rows and their share) of rows with `flags`."""
    per = tagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    total = tagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("flags") > 0).alias("flagged"))
    return per, total.withColumn("percent", F.round(100 * F.col("flagged") / F.nullif("rows", F.lit(0)), 1))


def repeated_repairs(cases: DataFrame) -> DataFrame:
    """One row: how many cases say again what another of their thread says, by the first 60 letters of the repair."""
    plain = F.left(F.trim(F.regexp_replace(F.lower(F.coalesce("resolution", F.lit(""))), "[^a-z0-9]+", " ")), F.lit(60))
    keys = cases.where(F.coalesce("thread_url", F.lit("")) != "").groupBy("thread_url", plain.alias("fix")).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated"))


def top_reasons(rows: DataFrame, reason: str, n: int = 5) -> DataFrame:
    counted = rows.where(F.coalesce(reason, F.lit("")) != "").groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), reason).limit(n).withColumn("shown", F.format_string("%s (×%d)", F.col(reason), F.col("n")))
