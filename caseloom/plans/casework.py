"""Repair, review, planning and audit queries over the knowledge base's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dedup, gates, metrics, planner, sampling
from ..sources import readers, sinks
from .domain import rows_of, scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_none = lambda kind="string": F.lit(None).cast(kind)
_stamp = lambda s: F.lit(s).cast("timestamp")
_strings = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))

# ---- repairs and duplicates

_SEEDS = "SELECT p_partkey AS seq, CASE WHEN p_size % 2 = 0 THEN 'ready' ELSE 'to_review' END AS stage, p_brand AS vehicle_brand, p_type AS vehicle_model, concat('p030', CAST(p_size % 3 AS STRING)) AS code, p_name AS description, 'Replaced the pump' AS resolution, concat('TSB REV ', chr(CAST(65 + p_partkey % 4 AS INT))) AS source_ref, CAST(2000 + p_partkey % 7 AS STRING) AS model_year FROM part"


@query(
    f"""WITH s AS ({_SEEDS}), r AS (SELECT *, row_number() OVER (PARTITION BY stage, vehicle_brand, vehicle_model, description, code ORDER BY source_ref DESC, model_year DESC, seq) AS n FROM s)
    SELECT max(seq) FILTER (n = 1) AS seq, string_agg(DISTINCT source_ref, ',' ORDER BY source_ref) AS refs, string_agg(DISTINCT model_year, ',' ORDER BY model_year) AS years, count(*) AS source_variant_count FROM r GROUP BY stage, vehicle_brand, vehicle_model, description, code"""
)
def collapse_seeds(spark, d):
    rows = rows_of(spark, d, _SEEDS)
    rows = rows.withColumns({"obd_codes": F.array("code", F.upper("code")), "source_refs": F.array("source_ref"), "model_years": F.array("model_year")})
    return dedup.collapse_seeds(rows).select("seq", F.array_join("source_refs", ",").alias("refs"), F.array_join("model_years", ",").alias("years"), "source_variant_count")


_REPAIR = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('t', CAST(o_custkey % 50 AS STRING)) END AS thread_url, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat(' A', CAST(o_orderkey % 3 AS STRING)) ELSE concat('a', CAST(o_orderkey % 3 AS STRING), ' ') END AS case_author, CASE o_orderstatus WHEN 'F' THEN 'imported' WHEN 'O' THEN 'verified' ELSE 'verify_rejected' END AS status, substr('xxxxx', 1, CAST(o_orderkey % 5 AS INT)) AS review_note, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders"


@query(
    f"""WITH c AS (SELECT *, lower(trim(coalesce(case_author, ''))) AS a, CASE status WHEN 'imported' THEN 90 WHEN 'verified' THEN 70 ELSE 10 END AS p FROM ({_REPAIR})),
    r AS (SELECT *, row_number() OVER (PARTITION BY thread_url, a ORDER BY p DESC, length(review_note) DESC, created_at, id) AS n FROM c) SELECT id, status FROM r WHERE n = 1 OR thread_url = '' OR a = ''"""
)
def repair_cases(spark, d):
    return dedup.repair_cases(rows_of(spark, d, _REPAIR)).select("id", "status")


_THREADS = "SELECT o_orderkey AS id, concat('forum', CAST(o_custkey % 5 AS STRING)) AS forum_id, concat('https://f.example/t/', CAST(o_custkey % 40 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '/' ELSE '' END) AS url, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS title, CASE o_orderstatus WHEN 'F' THEN 'extracted' WHEN 'O' THEN 'pending' ELSE 'discarded' END AS status, substr('yyyyyyyyy', 1, CAST(o_orderkey % 9 AS INT)) AS thread_text, CASE WHEN o_orderkey % 5 = 0 THEN concat('r', CAST(o_orderkey % 6 AS STRING)) WHEN o_orderkey % 5 = 1 THEN '' END AS discard_reason, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders"
_ROOT = "regexp_replace(url, '/$', '')"


@query(
    f"""WITH t AS (SELECT *, {_ROOT} AS root, CASE status WHEN 'extracted' THEN 50 WHEN 'pending' THEN 30 ELSE 10 END AS p FROM ({_THREADS})),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p DESC, length(thread_text) DESC, length(title) DESC, url <> root, created_at, id) AS n FROM t) WHERE n = 1),
    l AS (SELECT root, arg_max(title, length(title) * 10000000 + id) FILTER (title <> '') AS title, max(length(thread_text)) AS n_text FROM t GROUP BY 1),
    e AS (SELECT root, discard_reason FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY created_at, id) AS n FROM t WHERE coalesce(discard_reason, '') <> '') WHERE n = 1)
    SELECT f.id, f.forum_id, root AS url, l.title, f.status, e.discard_reason, l.n_text, f.created_at FROM f JOIN l USING (root) LEFT JOIN e USING (root)"""
)
def repair_threads(spark, d):
    kept, _ = dedup.repair_threads(rows_of(spark, d, _THREADS), F.regexp_replace("url", "/$", ""))
    return kept.select("id", "forum_id", "url", "title", "status", "discard_reason", F.coalesce(F.length("thread_text"), F.lit(0)).cast("long").alias("n_text"), "created_at")


@query(
    f"""WITH t AS (SELECT *, {_ROOT} AS root, CASE status WHEN 'extracted' THEN 50 WHEN 'pending' THEN 30 ELSE 10 END AS p FROM ({_THREADS})),
    f AS (SELECT id AS old_id, first_value(id) OVER (PARTITION BY root ORDER BY p DESC, length(thread_text) DESC, length(title) DESC, url <> root, created_at, id) AS new_id FROM t) SELECT * FROM f WHERE old_id <> new_id"""
)
def moved_threads(spark, d):
    return dedup.repair_threads(rows_of(spark, d, _THREADS), F.regexp_replace("url", "/$", ""))[1]


@query(
    """WITH r AS (SELECT l_orderkey AS thread_id, l_linenumber - 1 AS idx, CAST(max(l_quantity) AS INT) AS q FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY thread_id, CASE WHEN idx < 3 THEN 0 WHEN idx IN (4, 5) THEN 1 ELSE 100 + idx END ORDER BY q DESC, idx) AS n FROM r) SELECT thread_id, idx FROM k WHERE n = 1"""
)
def keep_richest(spark, d):
    """Judged clusters with a repeated place, places out of range, and clusters of one."""
    line = table(spark, d, "lineitem")
    tasks = dedup.tasks_for(line.count(), spark.sparkContext.defaultParallelism)  # counted in the footers
    line = dedup.by_thread(line.select(F.col("l_orderkey").alias("thread_id"), "l_linenumber", "l_quantity"), tasks)
    cases = line.groupBy("thread_id", (F.col("l_linenumber") - 1).alias("idx")).agg(F.struct(F.max("l_quantity").cast("int").alias("q")).alias("richness"))
    judged = F.array(*(F.array(*map(F.lit, c)) for c in ((0, 1, 2), (2, 4, 5, 9), (3,), (-1, 3))))
    clusters = line.select("thread_id").distinct().select("thread_id", F.lit(7).alias("size"), judged.alias("clusters"))
    return dedup.keep_richest(cases, dedup.cluster_members(clusters)).select("thread_id", "idx")


@query(
    """WITH k AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, lower(trim(role)) AS a, substr(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), 1, 100) AS k FROM conversations),
    f AS (SELECT id, turn, CASE WHEN a <> '' THEN min(turn) OVER (PARTITION BY conv_id, a) END AS fa, CASE WHEN k <> '' THEN min(turn) OVER (PARTITION BY conv_id, k) END AS fk, conv_id FROM k)
    SELECT id, conv_id * 1000 + least(CASE WHEN fa < turn THEN fa END, CASE WHEN fk < turn THEN fk END) AS other FROM f WHERE fa < turn OR fk < turn"""
)
def local_duplicates(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), F.col("role").alias("case_author"), F.col("text").alias("resolution"))
    return dedup.local_duplicates(rows)


_DECIDED = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'imported' END AS status FROM orders"


@query(f"SELECT id, CASE WHEN id % 3 = 0 AND status IN ('approved', 'pending') THEN 'rejected' ELSE status END AS status, id % 3 = 0 AND status IN ('approved', 'pending') AS changed FROM ({_DECIDED})")
def apply_decisions(spark, d):
    """With the backup, which alone reverts it."""
    cases = rows_of(spark, d, _DECIDED)
    after, backup = dedup.apply_decisions(cases, cases.where("id % 3 = 0").select("id", F.lit("rejected").alias("status")))
    return after.join(backup.select("id", F.lit(True).alias("changed")), "id", "left").select("id", "status", F.coalesce("changed", F.lit(False)).alias("changed"))


# ---- gates

_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


_POSTS = "SELECT conv_id, turn, role, text FROM conversations"


@query(
    """WITH p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn IN (0, 1, 2)) AS early, max(turn) AS last, count(*) FILTER (turn = 1 AND lower(role) <> 'user') AS foreign_one, count(*) FILTER (turn = 1) AS has_one, count(*) FILTER (turn = 2) AS has_two FROM conversations GROUP BY 1)
    SELECT conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'no_fault_posts' WHEN conv_id % 5 = 1 THEN 'no_fix_posts' WHEN conv_id % 5 = 2 THEN 'no_author' WHEN has_one < 1 THEN 'fault_post_missing' WHEN foreign_one > 0 THEN 'fault_post_author' WHEN (conv_id % 5 = 3 AND has_two < 1) OR conv_id % 5 = 4 THEN 'fix_post_missing' END AS author_reason FROM p"""
)
def cited_posts(spark, d):
    c = table(spark, d, "conversations")
    posts = c.select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("int").alias("number"), F.col("role").alias("author"), F.col("text").alias("body"))
    k = F.col("id") % 5
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    cases = c.select(F.col("conv_id").alias("id")).distinct().select(
        "id", F.col("id").alias("thread_id"), F.when(k == 2, "").otherwise("User").alias("case_author"), F.lit("Octavia").alias("vehicle_model"), F.when(k == 0, ints()).otherwise(ints(1)).alias("fault_posts"),
        F.when(k == 1, ints()).when(k == 4, ints(2, 99_999)).otherwise(ints(2)).alias("fix_posts"), F.lit("Octavia stalls").alias("title"),
    )
    return gates.checked_posts(cases, posts).select("id", "author_reason")


# ---- metrics, planning, samples

_OUTCOMES = "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'imported' WHEN 1 THEN 'verify_rejected' WHEN 2 THEN 'verified' WHEN 3 THEN 'import_failed' WHEN 4 THEN 'import_ready' WHEN 5 THEN 'crosscheck_dupe' ELSE 'pending' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders"


@query(f"SELECT rejected, passed, CASE WHEN rejected + passed > 0 THEN round(rejected / (rejected + passed), 3) ELSE 0.0 END AS rate FROM (SELECT count(*) FILTER (id % 7 = 1) AS rejected, count(*) FILTER (id % 7 IN (0, 2, 4, 5)) AS passed FROM ({_OUTCOMES}) WHERE created_at >= TIMESTAMP '1995-01-01 00:00:00')")
def reject_rate(spark, d):
    return metrics.reject_rate(rows_of(spark, d, _OUTCOMES), _stamp("1995-01-01 00:00:00"))


@query("SELECT *, parsed_rate >= 0.6 AND approved_rate >= 0.1 AND extracted_rate >= 0.05 AS passes FROM (SELECT *, round(parsed / threads, 6) AS parsed_rate, round(approved / threads, 6) AS approved_rate, round(extracted / threads, 6) AS extracted_rate FROM (SELECT count(*) AS threads, count(*) FILTER (event_type <> 'error') AS parsed, count(*) FILTER (event_type = 'purchase') AS approved, count(*) FILTER (event_type = 'purchase' AND value > 50) AS extracted FROM events))")
def probe_rates(spark, d):
    e = table(spark, d, "events")
    return metrics.probe_metrics(e.select((F.col("event_type") != "error").alias("parsed"), (F.col("event_type") == "purchase").alias("approved"), ((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("extracted")))


@query("SELECT p_partkey AS id, coalesce(p_size % 3 <> 0, false) AND coalesce(CASE WHEN p_size % 4 <> 0 THEN p_retailprice / 1000 END, 0) >= coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size / 50 END, 0) + 0.2 AS keep FROM part")
def recalibrations(spark, d):
    s = F.col("p_size")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(s % 3 == 0, F.when(s % 2 == 0, False)).otherwise(True).alias("succeeded"), F.when(s % 4 != 0, F.col("p_retailprice") / 1000).alias("candidate"), F.when(s % 5 != 0, s / 50).alias("baseline"))
    return metrics.guarded_recalibration(rows).select("id", "keep")


_LABELS = "SELECT event_id AS seq, CAST(user_id AS STRING) AS case_id, CAST(ts AS DATE) AS date, event_type = 'error' AS wrongly_accepted, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'c' WHEN 2 THEN 'none' END AS failed_condition, event_id % 10 = 0 AS parse_fail, event_id % 15 = 0 AS errored FROM events"
_TODAY = "2024-01-20"


@query(
    f"""WITH l AS ({_LABELS}), t AS (SELECT * FROM l WHERE date = DATE '{_TODAY}' AND NOT parse_fail AND NOT errored), p AS (SELECT count(*) FILTER (wrongly_accepted) AS pool_wrong, count(*) AS pool_judged FROM l WHERE date > DATE '{_TODAY}' - INTERVAL 7 DAY AND date <= DATE '{_TODAY}'),
    c AS (SELECT failed_condition AS clause, count(*) AS clustered, min(seq) AS s FROM t WHERE wrongly_accepted AND coalesce(failed_condition, 'none') <> 'none' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1),
    n AS (SELECT count(*) AS judged, count(*) FILTER (wrongly_accepted) AS wrong, count(*) FILTER (wrongly_accepted AND confidence = 'high') AS sure FROM t),
    r AS (SELECT judged, wrong, sure, (SELECT clause FROM c) AS clause, coalesce((SELECT clustered FROM c), 0) AS clustered, pool_wrong, pool_judged FROM n, p)
    SELECT *, wrong >= 3 AND judged >= 5 AND wrong / judged >= 0.1 AS nudge, wrong >= 3 AND judged >= 5 AND wrong / judged >= 0.1 AND clustered >= 3 AS cluster_hit, pool_wrong >= 5 AND pool_wrong / pool_judged >= 0.1 AS pooled_hit, (wrong >= 3 AND judged >= 5 AND wrong / judged >= 0.1 AND clustered >= 3) OR (pool_wrong >= 5 AND pool_wrong / pool_judged >= 0.1) AS alert FROM r"""
)
def precision_alert(spark, d):
    labels = rows_of(spark, d, _LABELS)
    day = F.to_date(F.lit(_TODAY))
    pool = metrics.pooled(labels.where(F.col("date") <= day), day, 7)
    return metrics.precision_alert(labels.where(F.col("date") == day), pool, rate=0.1)


_POINTS = "SELECT CAST(ts AS DATE) AS date, event_type AS scope, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY CAST(ts AS DATE), event_type"


@query(f"SELECT date, value FROM (SELECT date, CASE WHEN date = DATE '{_TODAY}' THEN -1.0 ELSE value END AS value, row_number() OVER (ORDER BY date DESC) AS n FROM ({_POINTS}) WHERE scope = 'click') WHERE n <= 14")
def metric_series(spark, d):
    """Tonight's points over the history's, then the last of one series."""
    history = rows_of(spark, d, _POINTS)
    tonight = history.where(F.col("date") == F.to_date(F.lit(_TODAY))).withColumn("value", F.lit(-1.0))
    return metrics.series(metrics.overlay(history, tonight), "click", "n", 14).select("date", "value")


@query("SELECT count(*) FILTER (event_type = 'error') > 0 OR (count(*) = 0) AS degenerate, count(*) FILTER (event_type = 'error') > 0 AS stopped FROM events")
def degenerate_night(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.when(F.col("event_type") == "error", "Quota reached").otherwise("done").alias("stop_reason"))
    return metrics.degenerate(runs, e, e)


@query("SELECT event_id, CAST(date_trunc('day', ts - INTERVAL 20 HOUR) + INTERVAL 20 HOUR AS TIMESTAMP) AS night FROM events")
def night_starts(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", metrics.night_start(F.col("ts").cast("timestamp"), 21, "+01:00").alias("night"))


_FORUMS = "SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'discovered' WHEN 1 THEN 'queued' WHEN 2 THEN 'active' WHEN 3 THEN 'exhausted' WHEN 4 THEN 'disqualified' WHEN 5 THEN 'calibration_failed' ELSE 'active' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS cooldown_until, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2023-12-01 00:00:00' END AS last_crawled_at, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS priority_score, s_suppkey % 2 = 0 AS archive_complete, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 6 - 2 END AS pending, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'pending' ELSE 'passed' END AS calibration_status, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE s_suppkey % 8 END AS calibration_attempts, TIMESTAMP '2023-01-01 00:00:00' AS created_at FROM supplier"
_OPEN = "status IN ('discovered', 'queued', 'active', 'exhausted') AND (cooldown_until IS NULL OR cooldown_until < TIMESTAMP '2024-02-01 00:00:00')"


@query(f"SELECT id, row_number() OVER (ORDER BY last_crawled_at IS NOT NULL, coalesce(priority_score, 0) DESC, last_crawled_at NULLS FIRST, id) AS place FROM ({_FORUMS}) WHERE {_OPEN}")
def forum_queue(spark, d):
    """The place of every forum that may be worked on."""
    queue = planner.forum_queue(rows_of(spark, d, _FORUMS), _stamp("2024-02-01 00:00:00"), None)
    return planner.placed(queue.select("id"), scratch(spark))


@query(f"SELECT id, row_number() OVER (ORDER BY coalesce(calibration_attempts, 0), created_at, id) AS place FROM ({_FORUMS}) WHERE {_OPEN} AND coalesce(calibration_status, 'pending') = 'pending' QUALIFY place <= 10")
def calibration_queue(spark, d):
    return _placed(planner.calibration_queue(rows_of(spark, d, _FORUMS), _stamp("2024-02-01 00:00:00")).select("id"))


def _placed(rows):
    """Rows of a short queue with their place: sorted partitions are numbered in order by their ids."""
    return rows.withColumn("k", F.monotonically_increasing_id()).select("id", F.row_number().over(Window.orderBy("k")).alias("place"))


@query(f"SELECT id, CASE WHEN rests THEN 'exhausted' ELSE 'active' END AS status, CASE WHEN rests THEN TIMESTAMP '2024-03-02 00:00:00' END AS cooldown_until, CASE WHEN rests THEN 720 END AS cooldown_tier_hours, CASE WHEN rests THEN TIMESTAMP '2024-02-01 00:00:00' END AS cooldown_set_at FROM (SELECT id, archive_complete AND coalesce(pending, 0) = 0 AS rests FROM ({_FORUMS}))")
def rest_rule(spark, d):
    return planner.rest_rule(rows_of(spark, d, _FORUMS), _stamp("2024-02-01 00:00:00")).select("id", "status", "cooldown_until", "cooldown_tier_hours", "cooldown_set_at")


@query("SELECT id FROM (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderkey % 5 AS attempts FROM orders) WHERE status = 'O' OR (status = 'F' AND attempts < 3)")
def retry_queue(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5).alias("attempts"), F.col("o_orderdate").alias("created_at"))
    return planner.retry_queue(rows, "O", "F", 3).select("id")


_BRANDS = "SELECT p_brand AS make, CASE min(p_partkey) % 6 WHEN 0 THEN 'coarse_done' WHEN 1 THEN 'live_import_done' WHEN 2 THEN 'awaiting_codex_review' WHEN 3 THEN 'rejected' WHEN 4 THEN 'refined_done' ELSE 'dry_import_done' END AS status, count(*) AS supported_rows FROM part GROUP BY 1"


@query(f"SELECT make, status, supported_rows FROM ({_BRANDS}) WHERE status IN ('coarse_done', 'awaiting_codex_review', 'refined_done') ORDER BY CASE status WHEN 'coarse_done' THEN 1 WHEN 'refined_done' THEN 2 ELSE 5 END, supported_rows DESC, make LIMIT 1")
def next_brand(spark, d):
    return planner.next_brand(rows_of(spark, d, _BRANDS))


@query(
    """WITH v AS (SELECT l_suppkey AS section, max(l_linenumber) FILTER (l_returnflag = 'A') AS ok, coalesce(bool_or(l_returnflag = 'N' AND l_linenumber > 3), false) AS ended, min(l_linenumber) FILTER (l_returnflag = 'R' AND l_linenumber > 5) AS failed FROM lineitem GROUP BY 1)
    SELECT s_suppkey AS section, coalesce(failed, ok + 1, 1) AS next_page, s_suppkey % 10 = 0 OR (coalesce(ended, false) AND failed IS NULL) AS done FROM supplier LEFT JOIN v ON section = s_suppkey"""
)
def archive_cursor(spark, d):
    line = table(spark, d, "lineitem")
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    outcome = F.when(flag == "A", "ok").when((flag == "N") & (n > 3), "end").when((flag == "R") & (n > 5), "error").otherwise("skipped")
    cursors = table(spark, d, "supplier").select(F.col("s_suppkey").alias("section"), F.lit(1).alias("next_page"), (F.col("s_suppkey") % 10 == 0).alias("done"))
    return planner.archive_cursor(cursors, line.select(F.col("l_suppkey").alias("section"), n.alias("page"), outcome.alias("outcome")))


@query(
    "SELECT s_suppkey AS id, CAST(CASE WHEN s_suppkey % 6 = 3 THEN 61.5 ELSE 50.0 END AS DOUBLE) AS priority_score, CASE WHEN s_suppkey % 5 = 0 THEN 24 END AS cooldown_tier_hours FROM supplier"
)
def reverted_changes(spark, d):
    """Applied, then changed by another hand where the id is odd, then reverted: that change stays."""
    forums = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(50.0).alias("priority_score"), F.when(F.col("s_suppkey") % 5 == 0, 24).alias("cooldown_tier_hours"))
    plan = forums.where("id % 3 = 0").select(F.col("id").alias("forum_id"), F.lit("priority").alias("knob"), F.lit("up").alias("direction"), F.lit(60.0).alias("priority_score"), _none("int").alias("cooldown_tier_hours"), F.lit("applied").alias("outcome"))
    after, journal = planner.applied_with_journal(forums, plan, F.to_date(F.lit(_TODAY)))
    touched = after.withColumn("priority_score", F.when((F.col("id") % 3 == 0) & (F.col("id") % 2 == 1), 61.5).otherwise(F.col("priority_score")))
    return planner.reverted(touched, journal)


_RISK = "(CASE WHEN length(trim(coalesce(fix, ''))) < 60 THEN 3 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)"
_AUDIT = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat('An Audi and a BMW. ', text) ELSE text END AS about, CASE WHEN doc_id % 5 = 0 THEN 'Cleaned it' WHEN doc_id % 2 = 0 THEN 'New pump' ELSE 'A very long account of what was done to the car, part after part' END AS fix FROM documents"


def _pool(spark, d):
    one = F.array(F.lit(1))
    none = F.array().cast("array<int>")
    rows = rows_of(spark, d, _AUDIT).select(F.col("doc_id"), F.col("doc_id").alias("id"), F.timestamp_seconds("doc_id").alias("created_at"), F.col("about").alias("description"), F.col("fix").alias("resolution"), F.when(F.col("doc_id") % 3 == 0, none).otherwise(one).alias("fix_posts"), F.when(F.col("doc_id") % 4 != 0, one).alias("fault_posts"))
    return sampling.with_risk(rows)


@query(f"SELECT doc_id, {_RISK} AS risk FROM ({_AUDIT})")
def audit_risk(spark, d):
    return _pool(spark, d).select("doc_id", "risk")


@query(
    f"""WITH p AS (SELECT doc_id AS id, {_RISK} AS risk, doc_id % 2 = 0 AS aud FROM ({_AUDIT})), f AS (SELECT id FROM p ORDER BY id DESC LIMIT 3), r AS (SELECT *, row_number() OVER (ORDER BY aud, risk DESC, id DESC) AS n FROM p WHERE id NOT IN (SELECT id FROM f)),
    d AS (SELECT *, row_number() OVER (ORDER BY aud, md5(concat('1:', CAST(id AS VARCHAR))), id) AS k FROM r WHERE n > 4), s AS (SELECT id FROM (SELECT id FROM d WHERE k > 2 ORDER BY aud, risk DESC, id DESC LIMIT 12) ORDER BY id LIMIT 3)
    SELECT id, 'fresh' AS slice FROM f UNION ALL SELECT id, 'risk' FROM r WHERE n <= 4 UNION ALL SELECT id, 'random' FROM d WHERE k <= 2 UNION ALL SELECT id, 'spill' FROM s"""
)
def audit_sample(spark, d):
    pool = _pool(spark, d)
    return sampling.audit_sample(pool, pool, pool.where("id % 2 = 0"), sample=12, random=2)


@query("SELECT event_id AS seq, user_id AS id FROM events ORDER BY event_id DESC LIMIT 500")
def last_audited(spark, d):
    return sampling.ring_buffer(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id")))


@query("SELECT doc_id AS idx, doc_id % 4 AS signal FROM documents ORDER BY (doc_id % 4 > 0) DESC, CASE WHEN doc_id % 4 > 0 THEN -(doc_id % 4) END, doc_id LIMIT 25")
def calibration_sample(spark, d):
    return sampling.calibration_sample(table(spark, d, "documents").select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 4).alias("signal")), 25)


# ---- reads and merges


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15 00:00:00' AND user_id IN (1, 2, 3, 5, 8, 13)")
def filtered_scan(spark, d):
    rows = readers.scan(spark, f"{d}/events.parquet", ["event_id", "user_id"], "2024-01-15 00:00:00", "ts", event_type="purchase")
    return readers.filtered(rows, user_id=[1, 2, 3, 5, 8, 13], event_id=None)


@query(
    """WITH i AS (SELECT p_brand, p_type, p_partkey, unnest([concat('m', CAST(p_size % 4 AS VARCHAR)), concat('m', CAST(p_size % 3 AS VARCHAR))]) AS m, unnest([0, 1]) AS k FROM part), o AS (SELECT p_brand, p_type, m, min(p_partkey * 2 + k) AS place FROM i GROUP BY 1, 2, 3), l AS (SELECT p_brand, p_type, string_agg(m, ', ' ORDER BY place) AS models FROM o GROUP BY 1, 2)
    SELECT p_brand AS make, p_type AS kind, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS seq, any_value(models) AS models FROM part JOIN l USING (p_brand, p_type) GROUP BY 1, 2"""
)
def merged_records(spark, d):
    models = F.concat(F.lit("m"), (F.col("p_size") % 4).cast("string"), F.lit(" ,, m"), (F.col("p_size") % 3).cast("string"))
    feed = table(spark, d, "part").select(F.col("p_brand").alias("make"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), models.alias("models"))
    return readers.merged_records(feed, ["make", "kind"], ["models"], "seq").select("make", "kind", "name", "seq", "models")


@query("SELECT p_type AS kind, p_size % 5 AS step, min(p_partkey) AS seq, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS models, string_agg(DISTINCT CAST(2000 + p_size % 4 AS VARCHAR), ',' ORDER BY CAST(2000 + p_size % 4 AS VARCHAR)) AS years, count(*) AS n FROM part GROUP BY 1, 2")
def pattern_groups(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("kind"), (F.col("p_size") % 5).alias("step"), F.col("p_brand").alias("model"), (2000 + F.col("p_size") % 4).cast("string").alias("model_year"))
    g = readers.pattern_groups(rows, ["kind", "step"])
    return g.select("kind", "step", F.col("first.seq").alias("seq"), F.array_join("models", ",").alias("models"), F.array_join("years", ",").alias("years"), "n")


@query("SELECT make, \"rows\", array_to_string(list_slice(models, 1, 8), ',') AS models, make IN ('BRAND#1', 'BRAND#3') AS supported FROM (SELECT upper(p_brand) AS make, count(*) AS \"rows\", list_sort(list_distinct(list(p_type))) AS models FROM part WHERE p_brand <> '' GROUP BY 1)")
def supported_makes(spark, d):
    known = spark.createDataFrame([("brand#1",), ("Brand#3",), ("Brand#99",)], "make string")
    feed = table(spark, d, "part").select(F.col("p_brand").alias("make"), F.col("p_type").alias("model"))
    return readers.supported_makes(feed, known).withColumn("models", F.array_join("models", ","))


@query("SELECT DISTINCT o_orderpriority AS file FROM orders WHERE o_orderstatus = 'P'")
def retry_files(spark, d):
    return readers.retry_files(table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status")))


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def appended_once(spark, d):
    old = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit("").alias("v"))
    new = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return sinks.missing(old, new.unionByName(new), ["k"]).select("k", "v")


@query("SELECT doc_id AS user_id, lang AS session_id, substr(text, 1, 200) AS vehicle_summary, substr(text, 1, 300) AS fault_summary FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def shared_snapshots(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), F.col("lang").alias("session_id"), F.col("text").alias("vehicle_summary"), F.col("text").alias("fault_summary"))
    old = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("user_id"), F.col("lang").alias("session_id"))
    return sinks.shared_snapshot(old, asked.unionByName(asked))


@query("SELECT 'price' AS rule, count(*) FILTER (NOT coalesce(p_retailprice > 950, false)) AS n FROM part UNION ALL SELECT 'size', count(*) FILTER (NOT coalesce(p_size BETWEEN 1 AND 40, false)) FROM part UNION ALL SELECT 'unique', count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1)")
def rule_violations(spark, d):
    return sinks.violations(table(spark, d, "part"), {"price": "p_retailprice > 950", "size": "p_size BETWEEN 1 AND 40"}, ("p_brand", "p_type", "p_size"))
