"""Dashboard, funnel and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model as M
from ..operators import analytics, faults, metrics, planner
from .domain import cte, rows_of, table, view

SINCE = "2024-01-10 00:00:00"
NOW = "2024-01-25 12:00:00"
EXCLUDE = ("building3@example.com", "machinery4@example.com")
_OUT = "(email IS NULL OR email NOT IN ('building3@example.com', 'machinery4@example.com'))"
_stamp = lambda s: F.lit(s).cast("timestamp")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    cte("usage", "users")
    + f"""SELECT u.user_id, coalesce(email, CAST(u.user_id AS STRING)) AS email, count(*) AS calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
    CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(input_tokens, 0)) + sum(coalesce(output_tokens, 0)) AS BIGINT) AS total_tokens
    FROM usage u LEFT JOIN users ON u.user_id = users.id WHERE u.created_at >= TIMESTAMP '{SINCE}' AND {_OUT} GROUP BY 1, 2 ORDER BY total_tokens DESC, 1 LIMIT 20"""
)
def top_users(spark, d):
    return analytics.top_users(view(spark, d, "usage"), view(spark, d, "users"), _stamp(SINCE), 20, EXCLUDE).select("user_id", "email", "calls", "input_tokens", "output_tokens", "total_tokens")


@query(
    cte("usage", "users")
    + f"""SELECT CAST(u.created_at AS DATE) AS day, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(DISTINCT user_id) AS users
    FROM usage u LEFT JOIN users ON u.user_id = users.id WHERE u.created_at >= TIMESTAMP '{SINCE}' AND {_OUT} GROUP BY 1"""
)
def usage_daily(spark, d):
    return analytics.ai_daily(view(spark, d, "usage"), view(spark, d, "users"), _stamp(SINCE), EXCLUDE)


@query(
    cte("sessions", "users")
    + f"""SELECT CAST(updated_at AS DATE) AS day, count(*) AS sessions, count(*) FILTER (CAST(created_at AS DATE) = CAST(updated_at AS DATE)) AS created, count(DISTINCT user_id) AS users
    FROM sessions s LEFT JOIN users ON s.user_id = users.id WHERE updated_at >= TIMESTAMP '1997-01-01 00:00:00' AND {_OUT} GROUP BY 1"""
)
def sessions_daily_filtered(spark, d):
    return analytics.sessions_daily(view(spark, d, "sessions"), view(spark, d, "users"), _stamp("1997-01-01 00:00:00"), EXCLUDE)


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders")
def status_stats(spark, d):
    return analytics.case_stats(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ("F", "O", "P"))


@query(
    cte("signups")
    + f"""SELECT count(*) AS total, count(*) FILTER (CAST(created_at AS DATE) = DATE '{NOW[:10]}') AS today, count(*) FILTER (created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS week,
    count(*) FILTER (created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS month FROM signups WHERE email IS NULL OR email <> 'u3@example.com'"""
)
def registered_windows(spark, d):
    return analytics.registered_users(view(spark, d, "signups"), _stamp(NOW), ("u3@example.com",))


@query(
    cte("sessions", "closed")
    + """, a AS (SELECT json_extract_string(data, '$.vehicle.brand') AS brand, count(*) AS sessions FROM sessions WHERE updated_at >= TIMESTAMP '1996-01-01 00:00:00' AND coalesce(json_extract_string(data, '$.vehicle.brand'), '') <> '' GROUP BY 1),
    b AS (SELECT vehicle_brand AS brand, count(*) AS cases FROM closed WHERE closed_at >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY 1)
    SELECT coalesce(a.brand, b.brand) AS brand, coalesce(sessions, 0) AS sessions, coalesce(cases, 0) AS cases FROM a FULL JOIN b ON a.brand = b.brand ORDER BY sessions DESC, cases DESC, brand LIMIT 20"""
)
def brand_full_outer(spark, d):
    return analytics.brand_stats(view(spark, d, "sessions"), view(spark, d, "closed"), _stamp("1996-01-01 00:00:00"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def status_histogram(spark, d):
    return analytics.histogram(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) >= 2")
def having_dupes(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return analytics.histogram(docs, "text_md5", least=2)


@query(
    cte("usage")
    + """SELECT id, user_id, recent, recent > 5 AS "over" FROM (SELECT id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS recent FROM usage)"""
)
def rate_limit_24h(spark, d):
    return analytics.rate_limited(view(spark, d, "usage"), 24, 5).select("id", "user_id", "recent", "over")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k, count(*) AS n FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') <> '' GROUP BY 1, 2")
def json_path_stats(spark, d):
    k = F.get_json_object("props", "$.k")
    return analytics.histogram(table(spark, d, "events").where(k.isNotNull() & (k != "")).select("event_type", (k.cast("int") % 10).alias("k")), "event_type", "k")


@query(
    """SELECT p_brand AS brand, n, CAST(round(n / max(n) OVER () * 100) AS BIGINT) AS percent FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)"""
)
def percent_of_largest(spark, d):
    return analytics.percent_of_most(analytics.histogram(table(spark, d, "part").withColumnRenamed("p_brand", "brand"), "brand"), "n")


_AUDITED = """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN ' ' WHEN doc_id % 3 = 0 THEN 'Škoda' ELSE 'KIA Motors' END AS vehicle_brand, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'Rio' END AS vehicle_model, CASE WHEN doc_id % 4 = 0 THEN 'noise' END AS symptom, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'Fixed: the pump!' ELSE text END AS description,
    CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'fixed the PUMP' WHEN 2 THEN 'see above, thanks' WHEN 3 THEN 'new pump' WHEN 4 THEN 'none of it needed more than a pump' ELSE text END AS resolution, CASE doc_id % 5 WHEN 0 THEN 'P0301' WHEN 1 THEN 'P03' WHEN 2 THEN ' u12af ' END AS code,
    CASE doc_id % 7 WHEN 0 THEN 'https://www.kia-club.org/t/1' WHEN 1 THEN 'https://skoda-club.net/t/2' WHEN 2 THEN 'no address' ELSE concat('https://x.example/', CAST(doc_id % 50 AS STRING)) END AS thread_url FROM documents"""


@query(
    f"""WITH c AS (SELECT *, trim(coalesce(description, '')) AS about, trim(coalesce(resolution, '')) AS fix, trim(vehicle_brand) AS b FROM ({_AUDITED})), n AS (SELECT *, trim(regexp_replace(lower(fix), '[^a-z0-9]+', ' ', 'g')) AS fw, trim(regexp_replace(lower(about), '[^a-z0-9]+', ' ', 'g')) AS aw FROM c)
    SELECT flag, n FROM (SELECT 'no_brand' AS flag, count(*) FILTER (b = '') AS n FROM n UNION ALL SELECT 'no_model', count(*) FILTER (vehicle_model IS NULL) FROM n UNION ALL SELECT 'no_problem_stated', count(*) FILTER (symptom IS NULL AND about = '') FROM n UNION ALL SELECT 'no_resolution', count(*) FILTER (fix = '') FROM n
    UNION ALL SELECT 'resolution_too_short', count(*) FILTER (fix <> '' AND length(fix) < 10) FROM n UNION ALL SELECT 'resolution_too_long', count(*) FILTER (length(fix) > 400) FROM n UNION ALL SELECT 'resolution_equals_description', count(*) FILTER (fix <> '' AND about <> '' AND fw = aw) FROM n
    UNION ALL SELECT 'resolution_filler', count(*) FILTER (length(fix) < 25 AND regexp_matches(fix, '(?i)\\b(viz výše|see above|n/a|none|unknown|nevím|tbd|xxx)\\b')) FROM n UNION ALL SELECT 'obd_malformed', count(*) FILTER (code = 'P03') FROM n
    UNION ALL SELECT 'brand_forum_mismatch', count(*) FILTER ((thread_url LIKE '%kia-club%' AND NOT contains(lower(vehicle_brand), 'kia')) OR (thread_url LIKE '%skoda-club%' AND NOT contains(lower(vehicle_brand), 'škoda'))) FROM n
    UNION ALL SELECT 'repeated', (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM n GROUP BY thread_url, substr(fw, 1, 60)))) WHERE n > 0"""
)
def audit_flags(spark, d):
    code = F.array_compact(F.array("code"))
    cases = rows_of(spark, d, _AUDITED).withColumns({"symptoms": F.array_compact(F.array("symptom")), "obd_codes": code})
    per, _ = analytics.flags(analytics.audit_flags(cases))
    return per.unionByName(analytics.repeated_repairs(cases).select(F.lit("repeated").alias("flag"), F.col("repeated").alias("n")))


@query(
    """SELECT host, CASE WHEN host IS NULL THEN 'bad' ELSE 'forum' END AS kind, n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1)"""
)
def url_host_stats(spark, d):
    return analytics.source_kinds(table(spark, d, "pages"), "url").select("host", "kind", "n")


_TOP = """SELECT discard_reason, count(*) AS n FROM threads WHERE coalesce(discard_reason, '') <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"""


@query(cte("threads") + f"SELECT discard_reason, n, concat(discard_reason, ' (×', CAST(n AS STRING), ')') AS shown FROM ({_TOP})")
def top_discard_reasons(spark, d):
    return analytics.top_reasons(view(spark, d, "threads"), "discard_reason")


_BUCKET = """CASE WHEN lower(coalesce(discard_reason, '')) LIKE '%too few posts%' THEN 'too_few_posts' WHEN lower(coalesce(discard_reason, '')) LIKE '%classifier rejected%' THEN 'classifier_reject'
 WHEN lower(coalesce(discard_reason, '')) LIKE '%no cases%' THEN 'extractor_empty' WHEN lower(coalesce(discard_reason, '')) LIKE 'transient%' OR lower(coalesce(discard_reason, '')) LIKE '%http 4%' OR lower(coalesce(discard_reason, '')) LIKE '%http 5%' OR lower(coalesce(discard_reason, '')) LIKE '%timeout%' THEN 'transient' ELSE 'other' END"""
_CONDITION = "CASE WHEN regexp_extract(coalesce(review_note, ''), '(?i)failed:([a-z_]+)', 1) <> '' THEN regexp_extract(review_note, '(?i)failed:([a-z_]+)', 1) WHEN review_note ILIKE '%pre-gate%' THEN 'pre-gate' ELSE 'other' END"


@query(
    cte("threads", "outcomes")
    + f""", t AS (SELECT count(*) FILTER (status NOT IN ('pending', 'deferred')) AS tp, count(*) FILTER (status = 'discarded') AS td FROM threads),
    c AS (SELECT count(*) AS e, count(*) FILTER (status IN ('verified', 'import_ready', 'imported', 'import_failed', 'crosscheck_dupe')) AS v, count(*) FILTER (status = 'imported') AS i, count(*) FILTER (status = 'verify_rejected') AS r FROM outcomes)
    SELECT 'threads_processed' AS metric, CAST(tp AS DOUBLE) AS value FROM t UNION ALL SELECT 'threads_discarded', td FROM t UNION ALL SELECT 'cases_extracted', e FROM c UNION ALL SELECT 'cases_verified', v FROM c
    UNION ALL SELECT 'cases_imported', i FROM c UNION ALL SELECT 'verify_rejected', r FROM c UNION ALL SELECT 'yield_rate', CASE WHEN tp > 0 THEN round(e / tp, 3) ELSE 0 END FROM t, c
    UNION ALL SELECT 'verify_pass_rate', CASE WHEN v + r > 0 THEN round(v / (v + r), 3) ELSE 0 END FROM c UNION ALL SELECT 'import_rate', CASE WHEN e > 0 THEN round(i / e, 3) ELSE 0 END FROM c
    UNION ALL SELECT concat('discarded:', {_BUCKET}), count(*) FROM threads WHERE status = 'discarded' GROUP BY 1 UNION ALL SELECT concat('verify_reject:', {_CONDITION}), count(*) FROM outcomes WHERE status = 'verify_rejected' GROUP BY 1"""
)
def funnel_metrics_long(spark, d):
    return metrics.night_metrics(view(spark, d, "threads"), view(spark, d, "outcomes"))


@query(
    cte("threads", "outcomes")
    + f""", b AS (SELECT forum_id, status, {_BUCKET} AS bucket FROM threads),
    t AS (SELECT forum_id, count(*) FILTER (NOT (status = 'error' OR bucket = 'transient') AND status NOT IN ('pending', 'deferred')) AS processed, count(*) FILTER (status = 'error' OR bucket = 'transient') AS transient, count(*) FILTER (bucket = 'too_few_posts') AS too_few FROM b GROUP BY 1),
    c AS (SELECT forum_id, count(*) AS extracted, count(*) FILTER (status IN ('verified', 'import_ready', 'imported')) AS good, count(*) FILTER (status = 'verify_rejected') AS rejected FROM outcomes GROUP BY 1)
    SELECT coalesce(t.forum_id, c.forum_id) AS forum_id, coalesce(good, 0) AS good, coalesce(rejected, 0) AS rejected, coalesce(processed, 0) AS processed, coalesce(extracted, 0) AS extracted, coalesce(transient, 0) AS transient, coalesce(too_few, 0) AS too_few FROM t FULL JOIN c ON t.forum_id = c.forum_id"""
)
def union_fullouter_zero_fill(spark, d):
    return metrics.forum_night(view(spark, d, "threads"), view(spark, d, "outcomes"))


def _nightly(spark, d):
    """Long metrics per event user group and day, as the planner reads them."""
    e = table(spark, d, "events").select(F.concat(F.lit("forum"), (F.col("user_id") % 12).cast("string")).alias("scope"), F.to_date("ts").alias("date"), "event_type")
    marks = {"forum_good": ("purchase",), "forum_rejected": ("error",), "forum_processed": ("purchase", "error", "click", "signup"), "forum_extracted": ("purchase", "error"), "forum_transient": (), "forum_too_few": ()}
    wide = e.groupBy("scope", "date").agg(*(F.count_if(F.col("event_type").isin(*v)).cast("double").alias(m) for m, v in marks.items()))
    return wide.unpivot(["scope", "date"], list(marks), "metric", "value")


_NIGHTS = """WITH n AS (SELECT concat('forum', CAST(user_id % 12 AS STRING)) AS scope, CAST(ts AS DATE) AS date, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS good, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS rejected, CAST(count(*) FILTER (event_type IN ('purchase', 'error', 'click', 'signup')) AS DOUBLE) AS processed FROM events GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY scope) AS nights FROM n),
 w AS (SELECT scope, nights, sum(good) FILTER (rn <= 3) AS good3, sum(processed) FILTER (rn <= 3) AS processed3, sum(rejected) FILTER (rn <= 3) AS rejected3, sum(good) FILTER (rn <= 2) AS good2, sum(processed) FILTER (rn <= 2) AS processed2 FROM r GROUP BY 1, 2)
"""


@query(_NIGHTS + "SELECT scope, nights, good3, processed3, round((good3 + 1) / (processed3 + 10) * 100, 1) AS target3, round((good2 + 1) / (processed2 + 10) * 100, 1) AS target2 FROM w")
def moving_yield(spark, d):
    w = planner.windows(planner.aligned(_nightly(spark, d)), F.to_date(F.lit("2024-02-01")), planner.Limits())
    target = lambda k: F.round(planner.smoothed(F.col(f"good{k}"), F.col(f"processed{k}")) * 100, 1).alias(f"target{k}")
    return w.select("scope", "nights", "good3", "processed3", target(3), target(2))


def _forums(spark, d):
    return _nightly(spark, d).select("scope").distinct().select(
        F.col("scope").alias("id"), F.lit("active").alias("status"), F.lit("none").alias("calibration_status"), (F.length("scope") * 10.0 - 45.0).alias("priority_score"),
        F.lit(None).cast("timestamp").alias("cooldown_until"), F.lit(None).cast("timestamp").alias("cooldown_set_at"), F.lit(None).cast("int").alias("cooldown_tier_hours"), F.lit(None).cast("int").alias("new_threads_last_batch"),
    )


_JOURNAL = "forum_id string, date date, knob string, direction string"


@query(
    _NIGHTS
    + """, t AS (SELECT scope, length(scope) * 10.0 - 45.0 AS cur, round((good3 + 1) / (processed3 + 10) * 100, 1) AS far, round((good2 + 1) / (processed2 + 10) * 100, 1) AS near, processed3, good3 + rejected3 AS outs, nights FROM w WHERE scope <> 'forum3'),
    s AS (SELECT *, round(least(greatest(cur + least(greatest(far - cur, -15.0), 15.0), 0.0), 100.0), 1) AS score, CASE WHEN nights >= 3 AND processed3 >= 20 AND outs >= 5 THEN CASE WHEN far > cur + 5 AND near > cur THEN 'up' WHEN far < cur - 5 AND near < cur THEN 'down' END END AS dir FROM t),
    c AS (SELECT scope, dir, score, abs(score - cur) AS strength FROM s WHERE dir IS NOT NULL AND abs(score - cur) >= 0.5),
    tot AS (SELECT (SELECT count(*) FROM t WHERE nights >= 2) AS ev, (SELECT count(*) FROM c) AS ch)
    SELECT scope AS forum_id, dir AS direction, round(score, 1) AS priority_score, round(strength, 1) AS strength, CASE WHEN NOT (ev >= 4 AND ch > 0.9 * ev) AND row_number() OVER (ORDER BY strength DESC, scope) <= 8 THEN 'applied' ELSE 'deferred' END AS outcome FROM c, tot"""
)
def circuit_breaker_plan(spark, d):
    journal = spark.createDataFrame([], _JOURNAL).unionByName(spark.range(1).select(F.lit("forum3").alias("forum_id"), F.to_date(F.lit("2024-02-01")).alias("date"), F.lit("priority").alias("knob"), F.lit("up").alias("direction")))
    limits = planner.Limits(breaker=0.9)
    plan = planner.plan(_forums(spark, d), planner.aligned(_nightly(spark, d)), journal, _stamp("2024-02-01 06:00:00"), F.to_date(F.lit("2024-02-01")), limits)
    return plan.select("forum_id", "direction", F.round("priority_score", 1).alias("priority_score"), F.round("strength", 1).alias("strength"), "outcome")


@query(
    """SELECT CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 'unknown' WHEN o_totalprice < 100000 THEN '0-100' WHEN o_totalprice < 150000 THEN '100-150' WHEN o_totalprice < 200000 THEN '150-200' ELSE '200+' END AS band, o_orderpriority AS priority, count(DISTINCT o_custkey) AS cnt FROM orders GROUP BY 1, 2"""
)
def price_bands(spark, d):
    return table(spark, d, "orders").groupBy(M.mileage_band(F.col("o_totalprice")).alias("band"), F.col("o_orderpriority").alias("priority")).agg(F.countDistinct("o_custkey").alias("cnt"))


def _vehicles(spark):
    rows = [(k, f"src{k % 20}", m) for k, m in enumerate(("Octavia II (2006–2013)", "Octavia", "Transit MK7", "Mondeo MK3", "Almera N16", "Compass (2017–2024)", "3008", "Golf"))]
    return spark.createDataFrame(rows, "query_id int, brand string, model string")


def _counts(spark, d):
    cases = faults.with_model(view(spark, d, "cases"))
    labels = spark.createDataFrame([(f"fault_{k}", f"cs{k}", f"en{k}", f"de{k}", "engine" if k % 2 else "body") for k in range(7)], "id string, label_cs string, label_en string, label_de string, category string")
    return faults.known_faults(cases, labels, _vehicles(spark))


_SPLIT = {"Octavia II (2006–2013)": ("octavia", "2", "2006"), "Octavia III": ("octavia", "3", None), "Transit MK7 2.2 TDCi": ("transit", "mk7", None), "Mondeo MK III": ("mondeo", "mk3", None), "Almera N16": ("almera", "n16", None), "Compass (2017–2024)": ("compass", None, "2017"), "3008": ("3008", None, None), "Golf": ("golf", None, None)}
_ASKED = ((0, "src0", "octavia", "2", "2006"), (1, "src1", "octavia", None, None), (2, "src2", "transit", "mk7", None), (3, "src3", "mondeo", "mk3", None), (4, "src4", "almera", "n16", None), (5, "src5", "compass", None, "2017"), (6, "src6", "3008", None, None), (7, "src7", "golf", None, None))
_lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_values = lambda rows: ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)
_MATCHED = (
    cte("cases")
    + f""", s(label, fam, gen, yr) AS (VALUES {_values([(k, *v) for k, v in _SPLIT.items()])}), q(query_id, brand, fam, gen, yr) AS (VALUES {_values(_ASKED)}),
    m AS (SELECT query_id, canonical_fault_id AS fault_id, c.id, c.mileage, coalesce(nullif(c.source_ref, ''), c.id) AS origin, c.age,
     CASE WHEN mileage IS NULL OR mileage <= 0 THEN 'unknown' WHEN mileage < 100000 THEN '0-100' WHEN mileage < 150000 THEN '100-150' WHEN mileage < 200000 THEN '150-200' ELSE '200+' END AS band,
     CASE WHEN q.gen IS NOT NULL AND coalesce(s.gen, vehicle_generation) = q.gen THEN 'exact'
      WHEN (q.gen IS NULL OR coalesce(s.gen, vehicle_generation) IS NULL) AND q.yr IS NOT NULL AND coalesce(s.yr, vehicle_generation) = q.yr THEN 'exact'
      WHEN coalesce(s.gen, vehicle_generation) IS NULL AND coalesce(s.yr, vehicle_generation) IS NULL THEN 'unknown' ELSE 'other' END AS gen_match
     FROM cases c JOIN s ON c.vehicle_model = s.label JOIN q ON c.vehicle_brand = q.brand AND s.fam = q.fam WHERE c.status = 'approved'),
    k AS (SELECT query_id, fault_id, band, gen_match, count(DISTINCT origin) AS cnt FROM m GROUP BY ALL) """
)


@query(_MATCHED + "SELECT query_id, fault_id, CASE WHEN substr(fault_id, 7) IN ('0','1','2','3','4','5','6') THEN concat('en', substr(fault_id, 7)) END AS label_en, band, gen_match, cnt FROM k")
def known_faults(spark, d):
    return _counts(spark, d).select("query_id", "fault_id", "label_en", "band", "gen_match", "cnt")


@query(
    _MATCHED
    + """SELECT query_id, fault_id, CAST(sum(cnt) AS BIGINT) AS "all", """
    + ", ".join(f"CAST(coalesce(sum(cnt) FILTER (band = '{b}'), 0) AS BIGINT) AS \"{b}\"" for b in M.BANDS)
    + " FROM k WHERE gen_match IN ('exact', 'other', 'unknown') AND fault_id IS NOT NULL AND fault_id <> 'other' GROUP BY 1, 2"
)
def pivot_bands(spark, d):
    return faults.fault_panel(_counts(spark, d), ("exact", "other", "unknown")).select("query_id", "fault_id", "all", *M.BANDS)


@query(_MATCHED + "SELECT query_id, CAST(coalesce(sum(cnt) FILTER (gen_match = 'exact'), 0) AS BIGINT) AS total, CAST(coalesce(sum(cnt) FILTER (gen_match = 'exact' AND (fault_id IS NULL OR fault_id = 'other')), 0) AS BIGINT) AS unclassified, CAST(coalesce(sum(cnt) FILTER (gen_match = 'unknown'), 0) AS BIGINT) AS gen_unknown FROM k GROUP BY 1")
def fault_panel_totals(spark, d):
    return faults.panel_totals(_counts(spark, d))


@query(
    _MATCHED
    + """, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, origin ORDER BY age DESC, id) AS n FROM m WHERE fault_id = 'fault_2' AND (gen_match = 'exact' OR query_id % 2 = 1))
    SELECT query_id, id, mileage, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY age DESC, id) AS rank FROM one WHERE n = 1) WHERE rank <= 25"""
)
def distinct_on_newest(spark, d):
    cases = faults.with_model(view(spark, d, "cases").withColumn("closed_at", F.timestamp_seconds(F.col("age"))))
    asked = _vehicles(spark).withColumns({"fault_id": F.lit("fault_2"), "band": F.lit(None).cast("string"), "gen": F.when(F.col("query_id") % 2 == 1, "all").otherwise("exact")})
    return faults.known_fault_cases(cases, asked, 99).select("query_id", "id", "mileage", "rank")


_GOLD = {
    "Octavia II (2006–2013)": ("octavia", "2", "2006"), "Transit MK7 2.2 TDCi (2006–2013)": ("transit", "mk7", "2006"), "Mondeo MK III": ("mondeo", "mk3", None), "206 / 206+": ("206", None, None), "Almera N16": ("almera", "n16", None), "Astra H": ("astra", "h", None),
    "Compass (2017–present)": ("compass", None, "2017"), "2008": ("2008", None, None), "Golf FL": ("golf", None, None), "Škoda Fabia 2010": ("skoda fabia", None, None), "Focus Mark 4": ("focus", None, None), "Fiesta mkvii": ("fiesta", "mk7", None), "A4 B8": ("a4", "b8", None), "": (None, None, None),
}


@query(f"SELECT * FROM (VALUES {_values([(k, *v) for k, v in _GOLD.items()])}) AS t(model, family, gen, year)")
def model_split(spark, d):
    rows = spark.createDataFrame([(k,) for k in _GOLD], "model string")
    m = F.col("model")
    return rows.select("model", M.model_family(m).alias("family"), M.model_generation(m).alias("gen"), M.model_year(m).alias("year"))
