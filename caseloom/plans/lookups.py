"""Lookups, classifications and small functions over whole tables, and round trips of readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bulletins as B
from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..functions import vehicles as V
from ..operators import analytics, faults, gates, graph, linkage, review
from ..sources import readers, schemas, sinks
from ..streaming import jobs
from .casework import _CLEAN, _none, _stamp, _strings
from .domain import cte, rows_of, scratch, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _any(patterns) -> str:
    """The patterns that SQL's engine knows, as one."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns if "(?!" not in p).replace("'", "''")


def _pick(names, key: str) -> str:
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


# ---- vehicles and parts

_BRANDS = ("Škoda", "Audi", "Kia (US)", "Lada", "Mini", "GMC", "Tesla", "skoda", "Citroën", "Acura", "Ram")
_GROUPS = ", ".join(f"('{n}', '{g}')" for g, names in V.BRAND_GROUPS.items() for n in names)


@query(f"WITH g(brand, brand_group) AS (VALUES {_GROUPS}) SELECT p_partkey AS id, g.brand_group FROM (SELECT p_partkey, {_pick(_BRANDS, 'p_partkey')} AS brand FROM part) LEFT JOIN g USING (brand)")
def brand_groups(spark, d):
    return rows_of(spark, d, f"SELECT p_partkey AS id, {_pick(_BRANDS, 'p_partkey')} AS brand FROM part").select("id", V.brand_group(F.col("brand")).alias("brand_group"))


_TRUCKS = ("VNL (300)", "vnr", "VNL300", "N-Series", "F SERIES", "XC90", " VAH ", "VNRE (Electric)", "D-MAX")
_RECORDS = f"SELECT p_partkey AS id, {_pick(('Volvo', 'ISUZU', 'Ford', 'volvo'), 'p_size')} AS make, {_pick(_TRUCKS, 'p_partkey')} AS model FROM part"


@query(f"SELECT id, (lower(make) = 'volvo' AND regexp_matches(upper(trim(model)), '^(?:VN|VNL(?: \\(\\d+\\))?|VNR(?: \\(\\d+\\))?|VNRE(?: \\(ELECTRIC\\))?|VHD|VAH|VT)$')) OR (make = 'ISUZU' AND upper(trim(model)) IN ('N-SERIES', 'F-SERIES', 'F SERIES', 'H SERIES', 'T SERIES')) AS truck FROM ({_RECORDS})")
def commercial_models(spark, d):
    return rows_of(spark, d, _RECORDS).select("id", V.commercial_model(F.col("make"), F.col("model")).alias("truck"))


_ENGINES = f"SELECT p_partkey AS id, {_pick(('Octavia III (2012–2020)', 'Golf Mk5', 'Passat B8', 'Superb II 2008–2015', 'A4  B5 Avant', 'Fabia'), 'p_partkey')} AS model, concat(CAST(p_size * 3 AS STRING), {_pick((' kW – 1.9 TDI', ' kw 1,4 TSI', ' hp 2.0', 'kW electric', ' kW 1.6 dCi', ' kW 3.0 V6 JTD'), 'p_size')}) AS engine FROM part"


@query(
    f"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(model, '\\s*\\(.*?\\)', '', 'g'), '\\s+B\\d\\b', '', 'g'), '(?i)\\s+Mk\\s*\\d+', '', 'g'), '\\s+[IVX]{{1,4}}\\b', '', 'g'), '\\s+\\d{{4}}\\s*[–-]?\\s*\\d{{0,4}}', '', 'g'), '\\s{{2,}}', ' ', 'g')) AS family,
    TRY_CAST(nullif(regexp_extract(engine, '(?i)(\\d{{1,9}})\\s*kW', 1), '') AS INT) AS kw, TRY_CAST(replace(nullif(regexp_extract(engine, '\\d[.,]\\d'), ''), ',', '.') AS DOUBLE) AS displacement, CASE WHEN regexp_matches(upper(engine), '{V.ENGINE_FUELS[0][1]}') THEN 'diesel' WHEN regexp_matches(upper(engine), '{V.ENGINE_FUELS[1][1]}') THEN 'petrol' END AS fuel FROM ({_ENGINES})"""
)
def manual_engines(spark, d):
    return rows_of(spark, d, _ENGINES).select("id", V.plain_model(F.col("model")).alias("family"), V.engine_hints(F.col("engine")).alias("e")).select("id", "family", "e.kw", "e.displacement", "e.fuel")


_FAULTS = ("Vadné turbodmychadlo a chladič oleje", "Glühkerze defekt", "EGR valve stuck", "žhavicí svíčky", "Spojka, setrvačník", "nothing known", "Fuel pump noise", "Snímač MAP", "brake pads worn", "Chladič")
_FAULT = f"SELECT p_partkey AS id, {_pick(_FAULTS, 'p_partkey')} AS fault FROM part"
_NAMES = ", ".join(f"('{k}', '{n.lower()}')" for k, names in V.PARTS.items() for n in (*names, k))
_HINTS = ", ".join(f"('{p}', '{g}')" for g, parts in V.REPAIR_GROUPS.items() for p in parts)


@query(
    f"""WITH n(part, name) AS (VALUES {_NAMES}), h(part, grp) AS (VALUES {_HINTS}), f AS ({_FAULT}), m AS (SELECT DISTINCT id, n.part FROM f JOIN n ON contains(lower(fault), name))
    SELECT id, string_agg(part, ', ' ORDER BY part) AS parts, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups FROM m LEFT JOIN h USING (part) GROUP BY 1"""
)
def named_parts(spark, d):
    rows = rows_of(spark, d, _FAULT).withColumn("parts", V.parts_named(F.col("fault"))).where(F.size("parts") > 0)
    each = rows.select("id", F.explode("parts").alias("part"))
    groups = each.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(V.repair_group(F.col("part")))), ",").alias("groups"))
    return rows.join(groups, "id").select("id", F.array_join("parts", ", ").alias("parts"), F.nullif("groups", F.lit("")).alias("groups"))


@query(f"WITH n(part, name) AS (VALUES {_NAMES}) SELECT id, coalesce(max(n.part) FILTER (name <> lower(n.part) OR name = 'maf sensor' OR name = 'map sensor'), any_value(term)) AS part FROM (SELECT p_partkey AS id, {_pick(('Turbo ', 'spojka', 'Kühler', 'clutch', 'XYZ', 'MAF sensor'), 'p_partkey')} AS term FROM part) LEFT JOIN n ON name = trim(lower(term)) GROUP BY 1")
def translated_parts(spark, d):
    rows = rows_of(spark, d, f"SELECT p_partkey AS id, {_pick(('Turbo ', 'spojka', 'Kühler', 'clutch', 'XYZ', 'MAF sensor'), 'p_partkey')} AS term FROM part")
    return rows.select("id", V.part_name(F.col("term")).alias("part"))


_MILEAGE = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(o_custkey AS STRING), ' 500 km') WHEN 1 THEN '' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL WHEN 4 THEN concat('ca. ', CAST(o_custkey AS STRING), '.000') ELSE CAST(o_custkey AS STRING) END AS mileage FROM orders"


@query(f"SELECT id, CASE WHEN trim(coalesce(mileage, '')) <> '' THEN coalesce(TRY_CAST(regexp_replace(mileage, '[^0-9]+', '', 'g') AS BIGINT), 0) END AS mileage FROM ({_MILEAGE})")
def mileage_numbers(spark, d):
    return rows_of(spark, d, _MILEAGE).select("id", V.mileage_number(F.col("mileage")).alias("mileage"))


@query("""SELECT c_custkey AS id, concat('{"id":', CAST(c_custkey AS VARCHAR), ',"vehicle":{"brand":"', c_mktsegment, '"}}') AS stored FROM customer""")
def without_identity(spark, d):
    vehicle = F.struct(F.col("c_mktsegment").alias("brand"), F.lit("vin").alias("identType"), F.col("c_name").alias("identValue"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.to_json(V.without_identity(F.struct(F.col("c_custkey").alias("id"), vehicle.alias("vehicle")))).alias("stored"))


# ---- review and coverage

_DISCARDED = f"SELECT event_id AS seq, concat('forum', CAST(user_id % 4 AS STRING)) AS forum_id, {_pick(('Too few posts (2)', 'Looks like a Classified ad', 'no resolution found', '', ' ', 'pinned thread', 'HTTP 503', 'asks for a service manual, not a case'), 'event_id')} AS discard_reason FROM events"
_CLASS = f"CASE WHEN trim(discard_reason) = '' THEN 'other' WHEN regexp_matches(discard_reason, '(?i)too few posts') THEN 'too_few' WHEN regexp_matches(discard_reason, '{review.TERMINAL}') THEN 'terminal' ELSE 'recoverable' END"


@query(f"SELECT class, count(*) AS n FROM (SELECT {_CLASS} AS class FROM ({_DISCARDED}) WHERE forum_id = 'forum1') GROUP BY 1")
def discard_classes(spark, d):
    return review.recoverable(rows_of(spark, d, _DISCARDED), forum="forum1")[1]


@query(f"SELECT seq, class FROM (SELECT seq, {_CLASS} AS class FROM ({_DISCARDED})) WHERE class IN ('recoverable', 'too_few') ORDER BY seq LIMIT 40")
def recoverable_threads(spark, d):
    return review.recoverable(rows_of(spark, d, _DISCARDED), with_too_few=True, most=40)[0].select("seq", "class")


_SPLITS = "SELECT *, CASE WHEN doc_id % 3 = 0 THEN '2' END AS model_gen, CASE WHEN doc_id % 4 = 0 THEN '2012' END AS model_year, vehicle_model AS model_base FROM cases"


@query(cte("cases") + f"SELECT count(*) AS total, count(canonical_fault_id) AS classified, count(*) FILTER (canonical_fault_id = 'other') AS other, count(*) FILTER (coalesce(model_gen, model_year, vehicle_generation) IS NOT NULL) AS gen_known FROM ({_SPLITS}) WHERE status = 'approved'")
def taxonomy_coverage(spark, d):
    return review.coverage(_split(spark, d))


def _split(spark, d):
    i = F.col("doc_id")
    return view(spark, d, "cases").withColumns({"model_gen": F.when(i % 3 == 0, "2"), "model_year": F.when(i % 4 == 0, "2012"), "model_base": F.col("vehicle_model")})


@query(cte("cases") + f"SELECT vehicle_brand AS brand, model_base AS family, count(*) AS n FROM ({_SPLITS}) WHERE coalesce(model_gen, model_year, vehicle_generation) IS NULL GROUP BY 1, 2")
def gap_histogram(spark, d):
    return review.gap_histogram(_split(spark, d))


_SOURCES = f"SELECT page_id % 40 AS id, concat({_pick(('https://www.example-', 'http://forum-', 'https://Data-', 'ftp:bad ', 'https://my.club.'), 'page_id')}, CAST(page_id % 9 AS STRING), '.org/x') AS url, CASE WHEN page_id % 7 = 0 THEN true WHEN page_id % 7 = 1 THEN NULL ELSE false END AS is_forum FROM pages"


@query(f"SELECT id, string_agg(DISTINCT host, ',' ORDER BY host) AS domains FROM (SELECT id, regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\\.', '') AS host FROM ({_SOURCES}) WHERE NOT coalesce(is_forum, false)) WHERE host <> '' AND NOT regexp_matches(host, '{review.NOT_AUTHORITATIVE}') GROUP BY 1")
def independent_domains(spark, d):
    return review.independent_domains(rows_of(spark, d, _SOURCES)).withColumn("domains", F.array_join("domains", ","))


@query("SELECT o_orderkey AS id, u.email AS user_email FROM orders LEFT JOIN (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat(lower(c_mktsegment), CAST(c_custkey % 10 AS VARCHAR), '@example.com') END AS email FROM customer WHERE c_custkey % 4 <> 3) u ON u.id = o_custkey")
def cases_with_owner(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return review.with_owner(cases, view(spark, d, "users")).select("id", "user_email")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def review_list(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("closed_at"))
    return review.review_list(cases, 2_000).select("id")


@query("SELECT event_id AS id FROM events ORDER BY CAST(ts AS DATE) DESC, event_id LIMIT 1")
def latest_report(spark, d):
    return review.latest_report(table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("date"))).select("id")


@query("SELECT c_nationkey AS forum_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def cases_per_forum(spark, d):
    threads = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("forum_id"))
    return review.cases_per_forum(table(spark, d, "orders").select(F.col("o_custkey").alias("thread_id")), threads)


@query("SELECT o_orderkey AS id, c_nationkey AS forum_id FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")
def cases_in_window(spark, d):
    threads = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("forum_id"))
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("thread_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return review.cases_in_window(cases, threads, _stamp("1995-01-01 00:00:00"), _stamp("1997-01-01 00:00:00")).select("id", "forum_id")


_DICTIONARY = "SELECT DISTINCT p_type AS code, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN p_brand END AS brand_group FROM part"


@query(
    f"""WITH t AS (SELECT code, brand_group, concat(code, ' of ', coalesce(brand_group, 'all')) AS description FROM ({_DICTIONARY})), q AS (SELECT p_partkey AS query_id, p_type AS code, p_brand AS g FROM part), a AS (SELECT l_partkey AS query_id, count(*) AS answers FROM lineitem GROUP BY 1)
    SELECT query_id, coalesce(answers, 0) AS answers, coalesce(o.description, g.description) AS code_description FROM q LEFT JOIN a USING (query_id) LEFT JOIN t o ON o.code = q.code AND o.brand_group = q.g LEFT JOIN t g ON g.code = q.code AND g.brand_group IS NULL"""
)
def enriched_questions(spark, d):
    entries = rows_of(spark, d, _DICTIONARY).withColumn("description", F.concat("code", F.lit(" of "), F.coalesce("brand_group", F.lit("all"))))
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.upper("p_type").alias("code"), F.col("p_brand").alias("brand_group"))
    return review.enriched(asked, table(spark, d, "lineitem").select(F.col("l_partkey").alias("query_id")), entries)


@query("SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE n_nationkey END AS id FROM nation")
def section_texts(spark, d):
    """A third of the questions by id, a third by manual and title, a third without any section."""
    sections = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("manual"), F.col("n_name").alias("title"))
    k = F.col("n_nationkey")
    asked = table(spark, d, "nation").select(k.alias("query_id"), F.when(k % 3 == 0, k).alias("section_id"), F.col("n_regionkey").cast("string").alias("asked_manual"), F.when(k % 3 == 1, F.col("n_name")).otherwise("none").alias("asked_title"))
    return review.section_text(sections, asked).select("query_id", "id")


@query("SELECT event_id, hour(ts) BETWEEN 5 AND 8 AND event_id % 2 = 0 AS run, coalesce(CASE WHEN user_id % 5 <> 0 THEN user_id END, 0) < greatest(2 * (event_id % 30), 20) AS advance FROM events")
def gated_runs(spark, d):
    at = F.col("ts").cast("timestamp")
    last = F.when(F.col("event_id") % 2 == 1, F.to_date(at)).when(F.col("event_id") % 4 == 0, F.date_sub(F.to_date(at), 1))
    return table(spark, d, "events").select("event_id", review.once_a_day(at, last).alias("run"), review.may_advance(F.when(F.col("user_id") % 5 != 0, F.col("user_id")), F.col("event_id") % 30).alias("advance"))


_KINDS = ("Service Bulletin/Repair Instructions", "warranty program/extension", "Owner Letter", "Service  Bulletin/Repair Instructions")
_SUMMARIES = ("The engine may stall. Replace the pump.", "Owner notification about a recall", "Contact TAC with pictures", "General information about the car", "Noise from the dash. Engineering is currently investigating. Replace nothing", "Leak at the pan was repaired", "The radio issue is fixed by an updated unit", "DTC P0301 set; reprogram the module")
_ABOUTS = ("Engine stalls at idle in traffic", "Too short", "Replace the pump at once", "Noise from the dashboard", "Some vehicles built on line two with the first radio may show a dark screen after a cold start in winter, and owners may hear a rattle at the same time")
_FIXES = ("Replaced the fuel pump", "Refer to the manual and replace it", "Tighten", "Explain it to the owner", "Noise from the dashboard")
_BULLETINS = f"SELECT doc_id AS id, {_pick(_KINDS, 'doc_id')} AS kind, {_pick(('Ford', 'gmc', 'Buick'), 'doc_id')} AS make, {_pick(_SUMMARIES, '(doc_id + doc_id // 8)')} AS summary, {_pick(_ABOUTS, '(doc_id // 3)')} AS about, {_pick(_FIXES, '(doc_id // 7)')} AS fix, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'stalling' END AS symptom, CASE WHEN doc_id % 10 = 0 THEN 'P0301' END AS code FROM documents".replace("doc_id // 8", "CAST(floor(doc_id / 8) AS BIGINT)").replace("doc_id // 3", "CAST(floor(doc_id / 3) AS BIGINT)").replace("doc_id // 7", "CAST(floor(doc_id / 7) AS BIGINT)")


@query(
    f"""WITH b AS (SELECT *, lower({_CLEAN.format('kind')}) AS k, {_CLEAN.format("concat(kind, ' ', summary)")} AS w FROM ({_BULLETINS})), s AS (SELECT *, regexp_matches(w, '{_any(gates.ACTION)}') AS acts, regexp_matches(w, '{_any(gates.SYMPTOM)}') OR code IS NOT NULL AS shows FROM b)
    SELECT id, CASE WHEN k NOT IN ('{gates.SERVICE}', '{gates.WARRANTY}') THEN 'communication_type' WHEN regexp_matches(w, '{_any(gates.NOTICE)}') THEN 'notice' WHEN upper(make) IN ('GMC', 'BUICK') AND regexp_matches(w, '{_any(gates.GROUP_NOTICE)}') THEN 'administrative' WHEN NOT acts AND NOT shows THEN 'no_symptom_no_action' WHEN length(about) < 12 THEN 'thin_description'
     WHEN regexp_matches(w, '{_any(gates.PREVENTIVE)}') THEN 'preventive' WHEN regexp_matches(about, '{_any(gates.ACTION_FIRST)}') OR lower(about) = lower(fix) THEN 'not_separated' WHEN starts_with(about, 'Some ') AND length(about) >= 135 THEN 'prose' WHEN length(fix) < 10 OR regexp_matches(fix, '{_any(gates.VAGUE_FIX)}') OR NOT regexp_matches(fix, '{_any(gates.ACTION)}') THEN 'weak_resolution'
     WHEN symptom IS NULL THEN 'no_symptom' WHEN NOT (regexp_matches(w, '{_any(gates.CONCRETE)}') OR code IS NOT NULL) THEN 'not_concrete' WHEN k = '{gates.SERVICE}' AND acts AND shows THEN 'complete' ELSE 'not_strong' END AS reason FROM s"""
)
def bulletin_stages(spark, d):
    rows = rows_of(spark, d, _BULLETINS)
    stage = gates.bulletin_stage(F.col("kind"), F.col("make"), F.col("summary"), F.col("about"), F.col("fix"), _strings(F.col("symptom")), _strings(F.col("code")))
    return rows.select("id", stage["reason"].alias("reason"))


# ---- scores and texts

_SCORED = f"SELECT p_partkey AS id, {_pick(('P0301', 'p2002', 'C1234', 'U0100', 'P1351'), 'p_partkey')} AS code, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE concat(CAST(p_size * 4000 AS STRING), ' km') END AS mileage, p_size % 11 AS confirmed, p_retailprice / 2000 AS ratio, p_size / 4.0 AS score, {_pick(('fault_1', 'other', ''), 'p_partkey')} AS fault FROM part"


@query(
    f"""WITH s AS (SELECT *, TRY_CAST(regexp_extract(mileage, '^\\s*([+-]?[0-9]{{1,18}})', 1) AS BIGINT) AS m FROM ({_SCORED})), r AS (SELECT *, least(m, 100000) / greatest(m, 100000) AS q FROM s)
    SELECT id, CASE WHEN regexp_matches(upper(code), '^P[02]') THEN 2.0 ELSE 5.0 END AS weight, CASE WHEN m > 0 THEN CASE WHEN q >= 0.7 THEN 2.0 WHEN q >= 0.5 THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS near, round(1 + (least(greatest(confirmed, 1), 8) - 1) / 7.0 * 0.12, 9) AS bonus, CASE WHEN ratio >= 0.72 THEN 'high' WHEN ratio >= 0.58 THEN 'mid' ELSE 'partial' END AS strength, score >= least(8.0, 10 * 0.7) AND ratio >= 0.5 AS passes, CASE WHEN fault = 'fault_1' THEN fault END AS fault FROM r""".replace("CASE WHEN regexp_matches(upper(code), '^P[02]') THEN 2.0 ELSE 5.0 END", "CAST(CASE WHEN regexp_matches(upper(code), '^P[02]') THEN 2.0 ELSE 5.0 END AS DOUBLE)").replace("CASE WHEN m > 0 THEN CASE WHEN q >= 0.7 THEN 2.0 WHEN q >= 0.5 THEN 1.0 ELSE 0.0 END ELSE 0.0 END", "CAST(CASE WHEN m > 0 THEN CASE WHEN q >= 0.7 THEN 2.0 WHEN q >= 0.5 THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS DOUBLE)").replace("round(1 + (least(greatest(confirmed, 1), 8) - 1) / 7.0 * 0.12, 9)", "CAST(round(1 + (least(greatest(confirmed, 1), 8) - 1) / CAST(7 AS DOUBLE) * 0.12, 9) AS DOUBLE)")
)
def score_parts(spark, d):
    c = F.col
    return rows_of(spark, d, _SCORED).select(
        "id", S.code_weight(c("code")).alias("weight"), S.mileage_score(F.lit("100000"), c("mileage")).alias("near"), F.round(S.confirmation_bonus(c("confirmed")), 9).alias("bonus"),
        S.strength(c("ratio"), c("score")).alias("strength"), S.passes(c("score"), c("ratio"), F.lit(10.0)).alias("passes"), S.fault_key(c("fault")).alias("fault"),
    )


_SAID = f"SELECT doc_id AS id, concat({_pick(('Some ', 'The following cars: ', '', 'Cars equipped with it: ', '  These  '), 'doc_id')}, text) AS about, CASE WHEN doc_id % 3 = 0 THEN 'https://static.nhtsa.gov/odi/tsbs/1' WHEN doc_id % 3 = 1 THEN 'https://forum.example/1' END AS url FROM documents"
_PROSE = f"((length(t) >= 135 AND regexp_matches(t, '{S.PROSE_START}')) OR (length(t) >= 160 AND regexp_matches(t, '{S.PROSE_BODY}')))"


@query(f"SELECT id, {_PROSE} AS prose, coalesce(contains(url, '{S.BULLETIN_HOST}'), false) AND {_PROSE} AS suppressed FROM (SELECT *, {_CLEAN.format('about')} AS t FROM ({_SAID}))")
def suppressed_rows(spark, d):
    rows = rows_of(spark, d, _SAID)
    return rows.select("id", S.bulletin_prose(F.col("about")).alias("prose"), S.suppressed(F.col("url"), F.col("about"), F.array().cast("array<string>")).alias("suppressed"))


_FIXED = f"SELECT doc_id AS id, {_pick(('', 'short', 'aaaaaaaaaa bbb', 'pump pump pump', 'Replaced the pump'), 'doc_id')} AS fix, text, CASE WHEN doc_id % 2 = 0 THEN 'P0301' WHEN doc_id % 3 = 0 THEN 'PA301' ELSE 'U1A0C' END AS code, CASE WHEN doc_id % 2 = 0 THEN 'WVWZZZ1JZXW000001' ELSE ' wvwzzz1jzxw00000o' END AS vin, concat('b, a ,,', lang, ',a') AS list FROM documents"


@query(
    f"""SELECT id, CASE fix WHEN '' THEN 'empty' WHEN 'short' THEN 'too_short' WHEN 'aaaaaaaaaa bbb' THEN 'repeated_characters' WHEN 'pump pump pump' THEN 'too_few_words' END AS complaint, code <> 'PA301' AS shaped, id % 2 = 0 AS vin, array_to_string(list_filter(['b', 'a', list_l], lambda x: x <> ''), ',') AS listed
    FROM (SELECT *, CASE WHEN split_part(list, ',', 4) IN ('a', 'b') THEN '' ELSE split_part(list, ',', 4) END AS list_l FROM ({_FIXED}))"""
)
def checked_fields(spark, d):
    c = F.col
    return rows_of(spark, d, _FIXED).select("id", T.valid_resolution(c("fix")).alias("complaint"), T.obd_shaped(c("code")).alias("shaped"), T.valid_vin(c("vin")).alias("vin"), F.array_join(T.comma_list(c("list")), ",").alias("listed"))


@query("SELECT doc_id, md5(CASE WHEN length(t) >= 40 THEN t ELSE '' END) AS text_md5 FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(concat('Reply', chr(10), text, chr(10), '#12', chr(10), 'Re: me'), chr(10)), lambda x: trim(x)), lambda x: NOT (x = '' OR regexp_matches(x, '(?i)^(citace|quote|l[ií]b[ií] se mi|sd[ií]let|odpov[eě]d[eě]t|report|share|like|reply|přidat komentář)$|^(re:|odp:|fw:|fwd:)|^(#\\d+|page \\d+ of \\d+)$'))), chr(10)) AS t FROM documents)")
def cleaned_posts(spark, d):
    t = F.concat_ws("\n", F.lit("Reply"), "text", F.lit("#12"), F.lit("Re: me"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_post(t).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, CASE WHEN length(t) >= 12 THEN 1 ELSE 0 END AS quoted FROM (SELECT doc_id, {_CLEAN.format('substr(text, 10, 60)')} AS t FROM documents)")
def verified_quotes(spark, d):
    """A passage in other spacing, one that isn't there, and one too short to count."""
    quotes = F.array(F.lower(F.regexp_replace(F.substring("text", 10, 60), " ", "  ")), F.lit("this was never said by anyone 123"), F.substring("text", 1, 5))
    return table(spark, d, "documents").select("doc_id", F.size(T.verified_quotes(quotes, F.col("text"))).alias("quoted"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'own' WHEN doc_id % 3 = 0 THEN 'held' ELSE 'own' END AS shown, CASE WHEN lang = 'en' THEN 'own' WHEN doc_id % 3 = 0 THEN 'held' END AS en, CASE WHEN lang = 'de' THEN 'own' END AS de FROM documents")
def localized_texts(spark, d):
    held = {"en": F.when(F.col("doc_id") % 3 == 0, "held").otherwise(""), "de": _none()}
    stored = T.assigned_translations(F.col("lang"), F.lit("own"), held)
    shown = T.localized(F.col("lang"), "en", F.lit("own"), held)
    return table(spark, d, "documents").select("doc_id", shown.alias("shown"), *(c.alias(k) for k, c in stored.items()))


_TITLES = ("[Vyřešeno] Octavia", "SOLVED: no start, fixed", "Motor gelöst", "Problem działa", "nothing", "Résolu et réparé")


@query(f"WITH w(lang, title, n) AS (VALUES ('cs', '{_TITLES[0]}', 1), ('en', '{_TITLES[1]}', 2), ('de', '{_TITLES[1]}', 2), ('fr', '{_TITLES[1]}', 2), ('es', '{_TITLES[1]}', 2), ('pl', '{_TITLES[1]}', 2), ('de', '{_TITLES[2]}', 1), ('pl', '{_TITLES[3]}', 1), ('fr', '{_TITLES[5]}', 2)) SELECT doc_id, coalesce(n, 0) AS n FROM (SELECT doc_id, {_pick(('pl', 'de', 'fr', 'en', 'es'), 'doc_id')} AS lang, {_pick(_TITLES, 'doc_id')} AS title FROM documents) LEFT JOIN w USING (lang, title)")
def resolution_signals(spark, d):
    rows = rows_of(spark, d, f"SELECT doc_id, {_pick(('pl', 'de', 'fr', 'en', 'es'), 'doc_id')} AS lang, {_pick(_TITLES, 'doc_id')} AS title FROM documents")
    return rows.select("doc_id", T.resolution_signal(T.fold_words(F.col("title")), F.col("lang")).alias("n"))


_PATHS = ("threads/x-1", "blog/topic/2", "viewtopic.php?t=1", "about", "topic/9", "index.php?thread/5-x", "t55-a", "tests/", "discussion/7", "news/showthread.php", "reviews", "t-1/")
_LINKS = f"SELECT page_id, concat('https://www.f.example/', {_pick(_PATHS, 'page_id')}) AS url FROM pages"


@query("SELECT page_id, page_id % 12 IN (0, 2, 4, 5, 6, 8) AS thread, page_id % 12 IN (6, 7, 11) AS own, 'f.example' AS domain FROM pages")
def likely_threads(spark, d):
    return rows_of(spark, d, _LINKS).select("page_id", U.likely_thread(F.col("url")).alias("thread"), U.likely_thread(F.col("url"), r"example/t(\d|ests|-)").alias("own"), U.domain(F.col("url")).alias("domain"))


_OWNERS = f"SELECT p_partkey AS id, {_pick(('BMW', 'Škoda', 'Honda', 'Yamaha'), 'p_partkey')} AS brand, {_pick(('R1200 GS', 'Octavia', 'Civic tractor', 'CBR 600', '320d'), 'p_size')} AS model, CASE WHEN p_partkey % 7 = 0 THEN 'Motorcycle' ELSE '2.0' END AS engine FROM part"


@query(f"SELECT id, regexp_matches(concat(lower(model), ' ', lower(engine)), '{B.NOT_CARS}') OR (lower(brand) IN ('bmw', 'honda', 'yamaha') AND lower(model) IN ('r1200 gs', 'cbr 600')) AS out_of_scope FROM ({_OWNERS})")
def out_of_scope(spark, d):
    return rows_of(spark, d, _OWNERS).select("id", B.out_of_scope(F.col("brand"), F.col("model"), F.col("engine")).alias("out_of_scope"))


# ---- linkage and manuals

_PROFILES = (("forum.example", "a"), ("forum.example/de", "b"), ("https://www.forum.example/de/auto/", "c"), ("other.example", "d"), ("example", "e"))
_SITES = f"SELECT page_id AS id, {_pick(('https://www.forum.example/de/auto/7', 'http://forum.example/de', 'https://forum.example/delta', 'https://sub.other.example/x?y=1', 'https://nowhere.test/', ''), 'page_id')} AS url FROM pages"


@query(f"SELECT id, CASE id % 6 WHEN 0 THEN 'c' WHEN 1 THEN 'b' WHEN 2 THEN 'a' WHEN 3 THEN 'd' END AS profile FROM ({_SITES})")
def longest_prefix(spark, d):
    profiles = spark.createDataFrame(list(_PROFILES), "match string, profile string")
    return linkage.longest_prefix(rows_of(spark, d, _SITES), profiles).select("id", "profile")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 3 AND p_brand IN ('Brand#1', 'Brand#2') THEN p_brand END AS known_brand, CASE WHEN p_size % 4 <> 3 AND p_brand IN ('Brand#1', 'Brand#2') THEN p_type END AS known_family FROM part")
def resolved_vehicles(spark, d):
    part = table(spark, d, "part")
    families = part.where("p_brand IN ('Brand#1', 'Brand#2')").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("family")).distinct()
    aliases = spark.createDataFrame([("B-One", "Brand#1"), ("b two!", "Brand#2")], "alias string, brand string")
    alias = F.when(F.col("p_brand") == "Brand#1", "b one").when(F.col("p_brand") == "Brand#2", "B Two")
    k = F.col("p_size") % 4
    brand = F.when(k == 0, F.col("p_brand")).when(k == 1, F.upper("p_brand")).when(k == 2, F.coalesce(alias, F.col("p_brand"))).otherwise("Unknown")
    rows = part.select(F.col("p_partkey").alias("id"), brand.alias("brand"), F.concat(F.lit(" "), F.lower("p_type")).alias("model"))
    return linkage.resolve_vehicle(rows, families, aliases).select("id", "known_brand", "known_family")


_POWERS = ("110 kW – 2.0 TDI", "81 kW – 1.6 TDI", "81 kW – 1.2 TSI", "no power")
_ASKED = ("110 kW", "81kW TSI 1.2", "81 kW", "2.0 TDI 110", "steam")


@query(f"SELECT id, CASE id % 5 WHEN 0 THEN '{_POWERS[0]}' WHEN 1 THEN '{_POWERS[2]}' WHEN 3 THEN '{_POWERS[0]}' END AS power FROM (SELECT p_partkey AS id FROM part) WHERE id % 5 IN (0, 1, 3)")
def engine_powers(spark, d):
    asked = rows_of(spark, d, f"SELECT p_partkey AS id, 'Octavia' AS label, {_pick(_ASKED, 'p_partkey')} AS engine FROM part")
    powers = spark.createDataFrame([("Octavia", p) for p in _POWERS], "label string, power string")
    return linkage.engine_power(asked, powers)


_LABELS = ("Octavia II (2004–2013)", "Octavia III (2012–2020)", "Octavia Tour (1996–2010)", "Fabia (2007–present)")


@query("SELECT id, CASE WHEN y BETWEEN 2012 AND 2013 THEN 'Octavia II (2004–2013)' WHEN y BETWEEN 2004 AND 2011 THEN 'Octavia II (2004–2013)' WHEN y BETWEEN 2014 AND 2020 THEN 'Octavia III (2012–2020)' ELSE 'Octavia Tour (1996–2010)' END AS label FROM (SELECT p_partkey AS id, 1994 + p_size % 30 AS y FROM part) WHERE y BETWEEN 1996 AND 2020")
def labels_by_year(spark, d):
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (1994 + F.col("p_size") % 30).alias("year"), F.lit("Octavia II").alias("text"))
    return linkage.resolve_by_years(asked, spark.createDataFrame([(x,) for x in _LABELS], "name string"))


@query("SELECT p_brand AS brand, p_type AS family, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS generations FROM part GROUP BY 1, 2")
def generation_options(spark, d):
    index = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"))
    return linkage.generation_options(index, F.col("kind")).withColumn("generations", F.array_join("generations", ","))


@query("SELECT 'EU' AS market, p_brand AS brand, CASE WHEN p_brand IN ('Brand#1', 'Brand#3') THEN concat(string_agg(DISTINCT p_type, ',' ORDER BY p_type), ',NEW') ELSE string_agg(DISTINCT p_type, ',' ORDER BY p_type) END AS models FROM part GROUP BY 2")
def merged_catalog(spark, d):
    catalog = table(spark, d, "part").groupBy(F.lit("EU").alias("market"), F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set("p_type")).alias("models"))
    extra = spark.createDataFrame([("EU", "Brand#1", ["NEW"]), ("EU", "Brand#3", ["NEW"]), ("US", "Brand#2", ["NEW"]), ("EU", "Brand#99", ["NEW"])], "market string, brand string, models array<string>")
    return linkage.merge_extra(catalog, extra).withColumn("models", F.array_join("models", ","))


def _manual(spark, d):
    sections = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") % 5).cast("string").alias("repair_group"), F.col("p_size").alias("pdf_page"), F.col("p_brand").alias("manual"))
    subs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("section"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("title"))
    return sections, subs


@query("WITH s AS (SELECT l_partkey AS section, string_agg(concat(CAST(l_linenumber AS VARCHAR), l_returnflag), ',' ORDER BY l_linenumber, l_returnflag) AS subsections FROM lineitem GROUP BY 1) SELECT p_partkey AS id, p_name AS title, p_size AS pdf_page, coalesce(subsections, '') AS subsections FROM part LEFT JOIN s ON section = p_partkey WHERE p_size % 5 = 2")
def browsed_group(spark, d):
    rows = graph.browse_group(*_manual(spark, d), "2")
    return rows.withColumn("subsections", F.array_join(F.transform("subsections", lambda x: F.concat(x["number"].cast("string"), x["title"])), ","))


@query("SELECT r_name AS model, r_name AS manuals, string_agg(DISTINCT concat(CAST(1.5 + n_nationkey % 2 AS VARCHAR), ' ', CASE WHEN n_nationkey % 3 = 0 THEN 'diesel' ELSE 'petrol' END), ',' ORDER BY concat(CAST(1.5 + n_nationkey % 2 AS VARCHAR), ' ', CASE WHEN n_nationkey % 3 = 0 THEN 'diesel' ELSE 'petrol' END)) AS engines FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def listed_vehicles(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    vehicles = region.select(F.col("r_name").alias("manual"), F.col("r_name").alias("model"))
    k = F.col("n_nationkey")
    engines = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("manual"), (1.5 + k % 2).cast("decimal(3,1)").alias("displacement"), F.when(k % 3 == 0, "diesel").otherwise("petrol").alias("fuel_type"))
    out = graph.list_vehicles(vehicles, engines)
    return out.select("model", F.array_join("manuals", ",").alias("manuals"), F.array_join("engines", ",").alias("engines"))


@query(
    """WITH q(query_id, w) AS (VALUES (1, 'small'), (1, 'ring'), (2, 'red'), (2, 'widget'), (2, 'deluxe')), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
    h AS (SELECT query_id, p_partkey AS section, count(*) AS hits FROM q JOIN (SELECT p_partkey, unnest(list_distinct(string_split(lower(concat(p_name, ' ', p_type)), ' '))) AS w FROM part) USING (w) GROUP BY 1, 2)
    SELECT query_id, section, score, rank FROM (SELECT query_id, section, hits / n AS score, row_number() OVER (PARTITION BY query_id ORDER BY hits / n DESC, section) AS rank FROM h JOIN n USING (query_id) WHERE hits / n > 0.3) WHERE rank <= 20"""
)
def token_search(spark, d):
    sections = table(spark, d, "part").select(F.col("p_partkey").alias("section"), F.col("p_name").alias("title"), F.col("p_type").alias("content"))
    asked = spark.createDataFrame([(1, "Small ring"), (2, "red widget, deluxe")], "query_id int, term string")
    return graph.token_search(sections, sections, asked)


@query(cte("cases") + """, k AS (SELECT CASE WHEN mileage IS NULL OR mileage <= 0 THEN 'unknown' WHEN mileage < 100000 THEN '0-100' WHEN mileage < 150000 THEN '100-150' WHEN mileage < 200000 THEN '150-200' ELSE '200+' END AS band, canonical_fault_id AS f, count(*) AS n FROM cases WHERE coalesce(canonical_fault_id, 'other') <> 'other' GROUP BY 1, 2)
    SELECT 1 AS query_id, CAST(sum(n) AS BIGINT) AS "all", CAST(sum(n) FILTER (band = '0-100') AS BIGINT) AS "0-100", CAST(sum(n) FILTER (band = '100-150') AS BIGINT) AS "100-150", CAST(sum(n) FILTER (band = '150-200') AS BIGINT) AS "150-200", CAST(sum(n) FILTER (band = '200+') AS BIGINT) AS "200+", CAST(sum(n) FILTER (band = 'unknown') AS BIGINT) AS unknown FROM k""")
def band_totals(spark, d):
    from ..functions import model as M

    rows = view(spark, d, "cases").select(F.lit(1).alias("query_id"), F.col("canonical_fault_id").alias("fault_id"), M.mileage_band(F.col("mileage")).alias("band"))
    counts = rows.groupBy("query_id", "fault_id", "band").agg(F.count(F.lit(1)).alias("cnt")).withColumns({c: _none() for c in ("label_cs", "label_en", "label_de", "category")} | {"gen_match": F.lit("exact")})
    return faults.band_totals(faults.fault_panel(counts))


# ---- streams' batch forms, readers and sinks


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND (doc_id % 5 = 0 OR doc_id % 900 >= 400) THEN 'pending' WHEN doc_id % 3 = 0 THEN 'deferred' ELSE 'processed' END AS status FROM documents")
def revived_threads(spark, d):
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("id"), F.when(i % 3 == 0, "deferred").otherwise("processed").alias("status"), F.when(i % 5 != 0, F.timestamp_seconds(1_700_000_000 + (400 - i % 900) * 86_400)).alias("revisit_after"))
    return jobs.revived(rows, now).select("id", "status")


@query("SELECT user_id, start, count(*) AS calls, count(*) > 3 AS \"over\" FROM (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS start, ts FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2")
def sliding_calls(spark, d):
    calls = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    return jobs.call_counts(calls, hours=24, slide="12 hours", most=3).select("user_id", "start", "calls", "over")


@query("SELECT DISTINCT user_id AS id FROM events")
def repeats_dropped(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.repeats_dropped(e, "id", "at").select("id")


@query("SELECT p_partkey AS nhtsa_id, p_brand AS make, p_name AS model, concat('first', chr(9), p_type) AS summary FROM part WHERE p_partkey % 5 <> 0")
def bulletin_feed(spark, d):
    """Written as a feed and read back: short lines go, further tabs belong to the summary."""
    p = table(spark, d, "part")
    fields = [F.lit("")] * len(schemas.BULLETIN)
    places = {c: k for k, c in enumerate(schemas.BULLETIN)}
    fields[places["nhtsa_id"]] = F.concat(F.lit(" "), F.col("p_partkey").cast("string"))
    fields[places["make"]], fields[places["model"]] = F.col("p_brand"), F.col("p_name")
    fields[places["summary"]] = F.concat(F.lit("first\t"), F.col("p_type"))
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws("\t", *fields[:5])).otherwise(F.concat_ws("\t", *fields))
    path = scratch(spark)
    p.select(line.alias("value")).write.text(path)
    return readers.bulletins(spark, path).select(F.col("nhtsa_id").cast("long").alias("nhtsa_id"), "make", "model", "summary")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 4 <> 0")
def json_log(spark, d):
    """JSON lines, every fourth of them damaged, read back."""
    line = F.to_json(F.struct("doc_id", "text"))
    path = scratch(spark)
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    return readers.json_lines(spark, path, "doc_id long, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(concat('\"', text, '\", ', chr(10), lang)) AS text_md5 FROM documents")
def csv_reports(spark, d):
    """Quotes, separators and line ends survive the CSV report."""
    path = scratch(spark)
    shown = F.concat(F.lit('"'), "text", F.lit('", \n'), "lang")
    sinks.reports(table(spark, d, "documents").select("doc_id", shown.alias("shown")), path)
    return readers.csv_report(spark, f"{path}/csv", "doc_id long, shown string").select("doc_id", F.md5(F.col("shown").cast("binary")).alias("text_md5"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' THEN 'to_review' ELSE 'discarded' END AS stage, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def staged_output(spark, d):
    stage = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "to_review").otherwise("discarded")
    rows = table(spark, d, "orders").select("o_custkey", stage.alias("stage"))
    path = scratch(spark)
    sinks.staged(rows, path)
    back = spark.read.schema("o_custkey long, stage string").json(path)
    return sinks.stage_summary(back).join(back.groupBy("stage").agg(F.sum("o_custkey").alias("total")), "stage")


@query("SELECT CAST(ts AS DATE) AS date, event_type AS scope, 'n' AS metric, CAST(CASE WHEN day(ts) % 2 = 0 THEN -1 ELSE count(*) END AS DOUBLE) AS value FROM events GROUP BY CAST(ts AS DATE), event_type, day(ts)")
def metric_versions(spark, d):
    """Two batches through the metric sink, the second given twice: versions are swapped whole."""
    points = table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("scope"), F.lit("n").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    path = scratch(spark)
    write = jobs.metric_writer(path)
    write(points, 0)
    later = points.where(F.day("date") % 2 == 0).withColumn("value", F.lit(-1.0))
    write(later, 1)
    write(later, 1)
    return sinks.read_current(spark, path)


# ---- keys, addresses and files


@query(cte("cases") + """SELECT id, md5(concat(lower(source_ref), '||', lower(vehicle_brand), '||', lower(vehicle_model), '||', CASE WHEN doc_id % 2 = 0 THEN 'P0101,P0301' ELSE '' END, '||', lower(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g'))), '||fixed it')) AS key_md5 FROM cases""")
def canonical_keys(spark, d):
    c = F.col
    codes = F.when(c("doc_id") % 2 == 0, F.array(F.lit("p0301 "), F.lit("P0101"), F.lit("P0301"), F.lit("")))
    key = S.canonical_key(c("source_ref"), c("vehicle_brand"), c("vehicle_model"), codes, c("description"), F.lit(" Fixed  it"))
    return view(spark, d, "cases").select("id", F.md5(key.cast("binary")).alias("key_md5"))


_INDEXED = f"SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('https://www.host', CAST(page_id % 3 AS STRING), '.example/', {_pick(('cars', 'vans'), 'page_id')}, '/t-', CAST(page_id % 20 AS STRING)) END AS thread_url, CASE WHEN page_id % 5 = 0 THEN concat('TSB / NHTSA ', CAST(page_id % 15 AS STRING)) ELSE 'TSB' END AS source_ref FROM pages"


@query(f"SELECT host, section, count(DISTINCT thread_url) AS threads, count(DISTINCT number) AS bulletins, count(*) FILTER (thread_url IS NULL AND number IS NULL) AS unindexable FROM (SELECT *, coalesce(regexp_extract(thread_url, 'www[.]([^/]+)', 1), '') AS host, coalesce(regexp_extract(thread_url, 'example/([^/]+)', 1), '') AS section, nullif(regexp_extract(source_ref, 'NHTSA ([0-9]+)', 1), '') AS number FROM ({_INDEXED})) GROUP BY 1, 2")
def crawled_index(spark, d):
    return analytics.crawled_index(rows_of(spark, d, _INDEXED))


@query("SELECT concat('c', CAST(conv_id AS VARCHAR)) AS local_id FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t, min_by(text, turn) AS first FROM conversations GROUP BY 1) WHERE length(t) >= 200 AND conv_id % 2 = 0 AND conv_id % 3 <> 0 AND conv_id % 5 <> 0 AND length(trim(regexp_replace(substr(first, 1, 40), '\\s+', ' ', 'g'))) >= 12")
def quoted_promotions(spark, d):
    """Open rows of the clause, pending cases, and quotes of which one in five was never said."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("thread_text"), F.min_by("text", "turn").alias("first"))
    t = t.withColumns({"local_id": F.concat(F.lit("c"), F.col("conv_id").cast("string")), "url": F.concat(F.lit("u"), F.col("conv_id").cast("string"))})
    k = F.col("conv_id")
    queue = t.select(F.col("local_id").alias("case_local_id"), F.when(k % 2 == 0, "d").otherwise("a").alias("clause"), _none("timestamp").alias("resolved_at"))
    cases = t.select("local_id", F.when(k % 3 == 0, "approved").otherwise("pending").alias("status"), F.col("url").alias("thread_url"))
    quotes = t.select("local_id", F.array(F.when(k % 5 == 0, "a passage that nobody ever wrote here").otherwise(F.substring("first", 1, 40))).alias("quotes"))
    return gates.quoted_promotions(queue, cases, t.select("url", "thread_text"), quotes).select("local_id")


@query("SELECT c_custkey AS id, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20) WHERE n = 1")
def answers_kept_once(spark, d):
    known = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("id"))
    answers = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return gates.kept_once(answers.unionByName(answers), known, "id", "o_orderkey")


@query("SELECT n_nationkey AS seq, n_name AS vehicle_brand FROM nation WHERE n_nationkey % 6 <> 0")
def seed_files(spark, d):
    """One JSON file per seed in a folder tree, some with a byte-order mark, some damaged."""
    path = scratch(spark)
    k = F.col("n_nationkey")
    body = F.to_json(F.struct(k.cast("long").alias("seq"), F.col("n_name").alias("vehicle_brand")))
    text = F.when(k % 6 == 0, "no json").when(k % 2 == 0, F.concat(F.lit(readers.BOM), body)).otherwise(body)
    table(spark, d, "nation").select(text.alias("value"), k.alias("folder")).repartition("folder").write.partitionBy("folder").text(path)
    return readers.seeds(spark, path, "*.txt").where("seq is not null").select("seq", "vehicle_brand")


_WHENS = f"SELECT event_id, {_pick(('2024-01-05T10:20:30Z', '1704450030', 'yesterday', '', '1704450030000', '2024-01-05'), 'event_id')} AS w FROM events"


@query(f"SELECT event_id, CASE WHEN w = '2024-01-05' THEN TIMESTAMP '2024-01-05 00:00:00' WHEN w LIKE '17044%' THEN TIMESTAMP '2024-01-05 10:20:30' WHEN w LIKE '2024-%' THEN TIMESTAMP '2024-01-05 10:20:30' END AS posted FROM ({_WHENS})")
def post_times(spark, d):
    return rows_of(spark, d, _WHENS).select("event_id", T.post_time(F.col("w")).alias("posted"))


_SOFT = ('<div class="postbody"></div><a href="viewtopic.php?t=1">phpBB</a>', '<div data-author="x" class="message-content"></div>', 'class="postbody" only one mark of one kind', '<div id="post_message_12" class="postcontent">', '<div class="ipsComment cPost">')


@query("SELECT page_id, ['phpbb', 'xenforo', 'generic', 'vbulletin', 'invision'][page_id % 5 + 1] AS software FROM pages")
def forum_software(spark, d):
    return table(spark, d, "pages").select("page_id", T.forum_software(F.concat(F.expr(_pick(_SOFT, "page_id")), F.lit(" " * 120))).alias("software"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 0 THEN concat('https://static.nhtsa.gov/odi/tsbs/', CASE WHEN p_size % 3 = 0 THEN '2021' ELSE '2019' END, '/MC-', CAST(p_partkey AS VARCHAR), '-0001.pdf') END AS url, CASE WHEN p_size % 3 = 0 THEN TIMESTAMP '2021-03-04 12:00:00' END AS day FROM part")
def bulletin_urls(spark, d):
    first = F.when(F.col("p_size") % 3 == 0, "20210304").otherwise("soon")
    number = F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), B.bulletin_url(number, first, F.lit("20190101")).alias("url"), B.bulletin_day(first).alias("day"))


@query("""SELECT p_partkey AS id, substr(sha256(concat('{"p_brand":"', p_brand, '","p_name":"', p_name, '"}')), 1, 16) AS local_id FROM part""")
def content_ids(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), B.content_id(F.col("p_brand"), F.col("p_name")).alias("local_id"))


@query(cte("usage") + "SELECT user_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM usage GROUP BY 1")
def token_totals(spark, d):
    return review.token_totals(view(spark, d, "usage"), "user_id")


@query("SELECT DISTINCT doc_id % 50 AS id, CASE doc_id % 50 % 3 WHEN 0 THEN 'Octavia II' ELSE 'Fabia' END AS label FROM documents WHERE doc_id % 50 % 3 <> 2")
def first_contexts(spark, d):
    """The first text that names one label clearly; one of two in a text is no answer."""
    k = F.col("id") % 3
    ids = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("id")).distinct()
    texts = F.array(F.lit("nothing here"), F.when(k == 0, "octavia ii").when(k == 1, "Fabia").otherwise("unknown car"), F.lit("octavia fabia"))
    contexts = ids.select("id", F.posexplode(texts).alias("pos", "text"))
    return linkage.first_resolved_context(contexts, spark.createDataFrame([("Octavia II",), ("Fabia",)], "name string"), 0.6, 0.03)
