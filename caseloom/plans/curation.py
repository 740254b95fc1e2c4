"""The gates of curation over whole tables.  The SQL writes its lists out; it shares none with what it checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, gates
from .domain import rows_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dealt(values, key: str = "doc_id") -> str:
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {shown(v)}" for k, v in enumerate(values)) + " END"


def _list(*columns: str):
    """The columns as a list without nulls."""
    return F.array_compact(F.array(*map(F.col, columns)))


_TRUE = '"in_scope": true, "vehicle_matches_cited_posts": true, "is_genuine_fault": true, "repair_performed": true, "repair_confirmed": true, "actionable": true'
_RAW = (
    "{" + _TRUE + "}",
    "Sure: {" + _TRUE.replace('performed": true', 'performed": false') + ', "reasons": {"repair_performed": " no fix "}} done',
    "{" + _TRUE.replace('"in_scope": true, ', "") + "}",
    "no json } here {",
    "{" + _TRUE.replace('scope": true', 'scope": false').replace('actionable": true', 'actionable": false') + "}",
    "{" + _TRUE.replace('confirmed": true', 'confirmed": "true"') + "}",
    None,
)


@query("SELECT doc_id, doc_id % 7 IN (2, 3, 5, 6) AS parse_fail, doc_id % 7 = 0 AS passed, CASE doc_id % 7 WHEN 1 THEN 'repair_performed' WHEN 4 THEN 'in_scope' END AS failed, CASE doc_id % 7 WHEN 0 THEN 'Verified by independent AI auditor' WHEN 1 THEN 'failed:repair_performed — no fix' WHEN 4 THEN 'failed:in_scope — no reason given' END AS reason FROM documents")
def structured_verdict(spark, d):
    """Whole texts stand around and in place of answers."""
    rows = rows_of(spark, d, f"SELECT doc_id, coalesce({_dealt(_RAW)}, replace(text, '{{', '(')) AS raw FROM documents")
    return rows.select("doc_id", curation.structured_verdict(F.col("raw")).alias("v")).select("doc_id", "v.*")


_ANSWERS = ('{"wrongly_accepted": true, "confidence": "high", "failed_condition": "b", "reason": "x"}', "garbage", 'Answer: {"wrongly_accepted": false, "failed_condition": "z"}', "{}", '{"confidence": "low", "failed_condition": "d"}', '{"wrongly_accepted": "true", "confidence": "sure"}')


@query("SELECT doc_id, doc_id % 6 = 1 AS parse_fail, doc_id % 6 = 0 AS wrongly_accepted, CASE doc_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN NULL WHEN 4 THEN 'low' WHEN 5 THEN 'sure' ELSE 'unknown' END AS confidence, CASE doc_id % 6 WHEN 0 THEN 'b' WHEN 4 THEN 'd' ELSE 'none' END AS failed_condition, CASE doc_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'unparseable' ELSE '' END AS reason FROM documents")
def precision_verdicts(spark, d):
    rows = rows_of(spark, d, f"SELECT doc_id, {_dealt(_ANSWERS)} AS raw FROM documents")
    return rows.select("doc_id", curation.precision_verdict(F.col("raw")).alias("v")).select("doc_id", "v.*")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 6 IN (2, 3, 5) THEN 'approved' ELSE 'queued' END AS outcome, doc_id % 6 = 1 OR doc_id % 6 = 0 AS wrong, CASE doc_id % 6 WHEN 0 THEN 'high' ELSE 'low' END AS confidence, doc_id % 4 = 0 AND doc_id % 7 <> 0 AND doc_id % 9 <> 0 AS classified FROM documents")
def triage_verdicts(spark, d):
    i = F.col("doc_id")
    rows = curation.triaged(rows_of(spark, d, f"SELECT doc_id, {_dealt(_ANSWERS)} AS raw FROM documents"))
    classified = gates.classifier_approved({"in_scope": F.when(i % 9 != 0, i % 4 == 0), "solved": i % 4 == 0}, F.when(i % 7 != 0, F.array(F.lit(1))))
    return rows.select(i.alias("id"), "outcome", F.col("verdict.wrongly_accepted").alias("wrong"), F.col("verdict.confidence").alias("confidence"), classified.alias("classified"))


_FIXES = ("Replaced the pump", "Replace the hose as needed", "Reprogram the display module", "Inspect it, then replace the module", "Update the phone module if the vehicle still stalls", "Replace the bracket if wear is found", "Flash the unit")
_ABOUT = ("The navigation display is slow.", "A DTC is stored.", "It rattles.", "No start, and the display is dark.", "The phone does not pair.")
_TAGS = ("Rattle at idle", " Noise ", None, "inoperative", "False deep sleep notification", "MIL on")
_DECISIONS = f"SELECT doc_id AS id, {_dealt(('accept', 'reject', None, 'accept', 'review', 'accept'))} AS decision, concat({_dealt(_FIXES)}, ' ', coalesce(text, '')) AS resolution, {_dealt(_ABOUT)} AS description, {_dealt(_TAGS)} AS tag, CASE WHEN doc_id % 13 = 0 THEN 'Second tag' END AS other, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 11 <> 1 END AS resolved, 'given' AS reason FROM documents"
_ONE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT *, lower({_ONE.format('resolution')}) AS fix, lower({_ONE.format('description')}) AS about, lower(trim(coalesce(tag, ''))) AS t FROM ({_DECISIONS})),
    g AS (SELECT *, CASE WHEN decision IS DISTINCT FROM 'accept' THEN NULL WHEN tag IS NULL AND other IS NULL THEN 'empty' WHEN t IN ('inoperative', 'warning light', 'mil on', 'noise', 'vct dtcs', 'lack of power', 'wrench indicator') THEN 'generic'
      WHEN regexp_matches(fix, '\\bas needed\\b|\\bif necessary\\b|\\bif (the )?concern persists\\b|\\bif concern remains\\b|\\bif (the )?issue persists\\b|\\bif symptoms persist\\b|\\bif the vehicle still\\b|\\bif .* (found|damaged|out of spec|cannot be established)\\b|\\bthen replace\\b') THEN 'conditional'
      WHEN regexp_matches(fix, '\\b(reprogram|update|flash)\\b') AND NOT regexp_matches(about, '\\b(dtc|no start|stall|won''t start|overheat|leak|limp|misfire|inoperative|charging|battery|power steering|engine coolant over temperature)\\b')
        AND (regexp_matches(about, '\\b(eta|sync|navigation|ambient|display|message|phone|connected service|deep sleep|performance issues)\\b') OR t IN ('sync performance issues', 'false deep sleep notification', 'inaccurate deep sleep notification')) THEN 'software' END AS stopped FROM d)
    SELECT id, CASE WHEN stopped IS NOT NULL OR (decision = 'accept' AND NOT coalesce(resolved, false)) THEN 'review' ELSE decision END AS decision,
    CASE stopped WHEN 'empty' THEN 'Second pass downgraded accept: empty symptoms after normalization.' WHEN 'generic' THEN 'Second pass downgraded accept: symptom tag is too generic for diagnostic retrieval.' WHEN 'conditional' THEN 'Second pass downgraded accept: repair action is conditional or decision-tree based.'
      WHEN 'software' THEN 'Second pass downgraded accept: software-only comfort/convenience bulletin is too weak for closed-case retrieval.' ELSE CASE WHEN decision = 'accept' AND NOT coalesce(resolved, false) THEN 'AI marked accept, but catalog mapping is unresolved and requires manual catalog confirmation first.' ELSE 'given' END END AS reason FROM g"""
)
def second_pass_decisions(spark, d):
    """The second pass over whole texts, then the catalog's say."""
    rows = rows_of(spark, d, _DECISIONS).withColumn("symptoms", _list("tag", "other"))
    return curation.catalog_enforced(curation.second_pass(rows)).select("id", "decision", "reason")


_SEED_ABOUT = ("A rattle from the roof", "The engine may stall", "A squeak, DTC stored", "The window operation is slow", " ", "Reduced power and a whine")
_SEED_FIX = ("Replace the bracket", "Refer to the manual", "Inspect the harness", "Repair the latch if necessary", "Clean and lubricate the hinge", "Then replace the module", None)
_SEED_TAG = ("No start", "DTC P0301", "p04ca stored", None, "one two three four five")
_SEEDS = f"SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE CAST(doc_id AS STRING) END AS local_id, source AS vehicle_brand, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'Golf' END AS vehicle_model, {_dealt(_SEED_ABOUT)} AS description, {_dealt(_SEED_FIX)} AS resolution, {_dealt(_SEED_TAG)} AS tag, CASE WHEN doc_id % 9 = 0 THEN 'Vibration at speed over 80' END AS other, CASE WHEN doc_id % 2 = 0 THEN 'P0301' END AS code, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS summary_raw, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id % 8 <> 1 END AS resolved FROM documents"


def _seeds(spark, d):
    return rows_of(spark, d, _SEEDS).withColumns({"symptoms": _list("tag", "other"), "obd_codes": _list("code")})


@query(
    f"""WITH s AS (SELECT *, trim(coalesce(description, '')) AS about, coalesce(resolution, '') AS fix, concat_ws(' ', tag, other, trim(description), resolution, {_ONE.format('summary_raw')}) AS t FROM ({_SEEDS})),
    r AS (SELECT id, CASE WHEN NOT coalesce(resolved, false) THEN 1 WHEN about = '' OR fix = '' OR (tag IS NULL AND other IS NULL) THEN 2 WHEN coalesce(tag, '') = 'one two three four five' OR other IS NOT NULL THEN 3
      WHEN regexp_matches(fix, '(?i)^(follow the (service|bulletin|bulletin repair) procedure|refer to|see bulletin|perform service action|this (service|technical) bulletin provides (repair information|a repair procedure)|inspect|check|verify|torque|clean and lubricate)\\b') THEN 4
      WHEN regexp_matches(t, '(?i)\\b(noise|rattle|clunk|squeak|whine|whining|moan|grinding|scrape|scraping|vibration|harsh ride|popping|flutter|ticking|manual door lock|heated seat|sunshade|power folding mirror|sharp curve warning|water leak center stack|roof rattle|window operation|wheel bearing noise|ess inoperative|check gas cap)\\b')
       AND NOT regexp_matches(t, '(?i)\\b(dtc|mil|no start|won[''’]?t start|stall|loss of propulsion|reduced power|limp mode|poor acceleration|overheat|overheating|leak|brake fluid|brake assist|hard brake pedal|incorrect gear ratio|slipping|jerking|rough shifts?|no charge|unable to charge|battery dead|dead battery|inoperative|remote start inoperative|start/stop inoperative|engine runs cold|no cabin heat)\\b') THEN 5 ELSE 0 END AS n FROM s)
    SELECT id, CASE WHEN n = 0 THEN 'ready' ELSE 'review' END AS stage, ['', 'Catalog mapping unresolved or missing.', 'Seed is missing core case fields after coarse extraction.', 'Symptom tags are too verbose for high-confidence refined ready.', 'Resolution still looks like procedural or generic bulletin guidance.', 'Low-value NVH/comfort/nuisance case moved out of refined ready.'][n + 1] AS reason FROM r"""
)
def refine_routes(spark, d):
    return curation.refined(_seeds(spark, d)).select("id", "stage", "reason")


@query(
    f"""WITH s AS (SELECT *, trim(coalesce(description, '')) AS about, coalesce(resolution, '') AS fix FROM ({_SEEDS})), k AS (SELECT count(*) AS n FROM s GROUP BY lower(coalesce(vehicle_brand, '')), coalesce(vehicle_model, ''), coalesce(code, ''), lower(about), lower(fix)),
    g AS (SELECT count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM k),
    c AS (SELECT count(*) AS seed_count, count(*) FILTER (tag = 'one two three four five') + count(*) FILTER (other IS NOT NULL) AS long_symptom_tags, count(*) FILTER (code IS NOT NULL AND tag IN ('DTC P0301', 'p04ca stored')) AS redundant_dtc_symptom_hits, count(*) FILTER (NOT coalesce(resolved, false)) AS unresolved_catalog_mapping,
      count(*) FILTER (regexp_matches(fix, '(?i)\\b(as needed|if necessary|then replace)\\b')) AS conditional_resolutions, count(*) FILTER (trim(local_id) = '' OR vehicle_model IS NULL OR coalesce(vehicle_brand, '') = '' OR about = '' OR fix = '' OR (tag IS NULL AND other IS NULL)) AS missing_core_fields FROM s)
    SELECT *, CAST(seed_count = 0 AS INT) AS empty_subset, seed_count > 0 AND duplicate_groups + long_symptom_tags + redundant_dtc_symptom_hits + unresolved_catalog_mapping + conditional_resolutions + missing_core_fields = 0 AS approved FROM c, g"""
)
def subset_summary(spark, d):
    return curation.subset_summary(_seeds(spark, d))


_TITLES = ("A fault", "Android Auto nejde", "Reset servisního intervalu", None, "Kódování jednotky", "Vibrace")
_TOLD = ("It stalls", "I was considering it", " ", "Noise when cold", None)
_REPAIRED = ("The pump was replaced", "It works again", "He recommends the bulbs", "everything was okay.", "  ", "The  PUMP was replaced!", "Problem sorted, thanks", "faulty pump", "Everything is ok since then, no fault")
_MODELS = ("Octavia III", "Transit / Tourneo", "Škoda Fabia", "", "Golf")
_FINAL = f"SELECT doc_id AS seq, CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('u', CAST(doc_id % 60 AS STRING)) END AS thread_url, {_dealt(_TITLES)} AS thread_title, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE source END AS case_author, {_dealt(_MODELS)} AS vehicle_model, CASE WHEN doc_id % 4 = 0 THEN 'my Fabia' ELSE 'octavia' END AS model_raw, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE concat('Noise ', CAST(doc_id % 2 AS STRING)) END AS tag, {_dealt(_TOLD)} AS description, {_dealt(_REPAIRED)} AS resolution, {_dealt(('ready', 'to_review_promoted', 'ready_import_only', 'other'))} AS source_bucket FROM documents"


def _final_sql(by_author: bool) -> str:
    worth = "CASE source_bucket WHEN 'ready_import_only' THEN 3 WHEN 'model_resolution_fetch_promoted' THEN 2 ELSE 1 END" if by_author else "CASE source_bucket WHEN 'ready' THEN 2 WHEN 'to_review_promoted' THEN 1 ELSE 0 END"
    key, order = ("thread_url, a, tag, f", f"{worth} DESC, length(resolution) DESC, seq") if by_author else ("thread_url, tag, f", f"{worth} DESC, seq")
    weak = "f = '' OR resolution LIKE 'Problem sorted%' OR resolution = 'faulty pump'" if by_author else "f = '' OR resolution IN ('It works again', 'He recommends the bulbs', 'everything was okay.') OR (resolution LIKE 'Everything is ok%' AND length(resolution) < 40)"
    own = (
        """UNION ALL SELECT seq, 'broad_vehicle_label' FROM k WHERE vehicle_model = 'Transit / Tourneo' UNION ALL SELECT seq, 'same_author_multi_case_thread' FROM k WHERE many > 1 UNION ALL SELECT seq, 'same_author_conflicting_model' FROM k WHERE many > 1 AND models > 1"""
        if by_author
        else """UNION ALL SELECT seq, 'model_context_conflict' FROM k WHERE (vehicle_model = 'Octavia III' AND model_raw = 'my Fabia') OR (vehicle_model = 'Škoda Fabia' AND model_raw = 'octavia') UNION ALL SELECT seq, 'non_fault_title' FROM k WHERE thread_title IN ('Android Auto nejde', 'Reset servisního intervalu', 'Kódování jednotky')
        UNION ALL SELECT seq, 'non_fault_description' FROM k WHERE description = 'I was considering it' UNION ALL SELECT seq, 'non_fault_resolution' FROM k WHERE resolution = 'He recommends the bulbs' OR resolution LIKE 'Everything is ok since then%'"""
    )
    return f"""WITH c AS (SELECT *, trim(regexp_replace(lower(resolution), '[^a-z0-9]+', ' ', 'g')) AS f, lower(coalesce(case_author, '')) AS a FROM ({_FINAL})), r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM c),
    g AS (SELECT thread_url, a, count(*) AS many, count(DISTINCT vehicle_model) AS models FROM r WHERE n = 1 GROUP BY 1, 2), k AS (SELECT * FROM r JOIN g USING (thread_url, a) WHERE n = 1)
    SELECT seq, 'exact_duplicate_case' AS issue FROM r WHERE n > 1 UNION ALL SELECT seq, 'missing_thread_identity' FROM k WHERE thread_url = '' OR thread_title IS NULL UNION ALL SELECT seq, 'model_not_in_catalog' FROM k WHERE vehicle_model IN ('', 'Golf') UNION ALL SELECT seq, 'missing_symptoms' FROM k WHERE tag IS NULL
    UNION ALL SELECT seq, 'missing_description' FROM k WHERE coalesce(trim(description), '') = '' UNION ALL SELECT seq, 'missing_resolution' FROM k WHERE f = '' UNION ALL SELECT seq, 'weak_resolution' FROM k WHERE {weak} {own}"""


def _final(spark, d, by_author: bool):
    rows = rows_of(spark, d, _FINAL).withColumn("symptoms", _list("tag"))
    catalog = spark.createDataFrame([("octavia iii",), ("Skoda Fabia",), ("Transit / Tourneo",)], "label string")
    return curation.safe_final(rows, catalog, by_author)[1]


@query(_final_sql(False))
def safe_final(spark, d):
    return _final(spark, d, False)


@query(_final_sql(True))
def safe_final_by_author(spark, d):
    return _final(spark, d, True)


_REVIEWED = f"SELECT doc_id AS id, {_dealt(('record', 'extractor', 'classifier', None, 'classifier'))} AS stage, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Golf' END AS model, doc_id % 2 = 0 AS ready, doc_id % 7 <> 0 AS should_seed, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 = 1 END AS has_confirmed_resolution, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 9 < 4 END AS has_required_fields FROM documents"


@query(
    f"""SELECT id, CASE WHEN stage = 'record' THEN CASE WHEN model = '' THEN 'model_resolution_needed' WHEN ready THEN 'promote_ready_candidate' ELSE 'record_hold' END WHEN stage = 'extractor' THEN 'manual_extraction_needed'
    WHEN stage = 'classifier' THEN CASE WHEN should_seed AND coalesce(has_confirmed_resolution, false) AND NOT coalesce(has_required_fields, true) THEN 'manual_review_classifier' WHEN NOT coalesce(has_confirmed_resolution, true) THEN 'reject_no_confirmed_resolution' ELSE 'manual_review_classifier' END ELSE 'unclassified_review_item' END AS final_status FROM ({_REVIEWED})"""
)
def retriage_rows(spark, d):
    return curation.retriaged(rows_of(spark, d, _REVIEWED)).select("id", "final_status")


_FOUND = '"is_relevant": true, "has_clear_symptoms": true, "has_clear_resolution": true, "matches_case_structure": true, "cleaned_symptoms": ["Fuel door stuck"], "cleaned_description": "The fuel door does not open.", '
_REVIEWS = (
    '{"decision": "accept", ' + _FOUND + '"cleaned_resolution": "Replace the latch of the door.", "reason": "clear"}',
    '{"decision": "Accept", ' + _FOUND + '"cleaned_resolution": "Refer to the manual and replace it.", "reason": "clear"}',
    '{"decision": "accept", ' + _FOUND.replace("true", '"true"', 1) + '"cleaned_resolution": "Replace the latch of the door."}',
    '{"decision": "reject", "reason": "no"}',
    '{"decision": "accept", ' + _FOUND + '"cleaned_resolution": "Some doors are built on old latches, replace them."}',
    "none",
)


@query("SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'accept' WHEN 3 THEN 'reject' ELSE 'review' END AS decision, CASE doc_id % 6 WHEN 0 THEN 'clear' WHEN 1 THEN 'clear' WHEN 3 THEN 'no' WHEN 5 THEN '' ELSE 'AI marked accept, but normalized output still failed structural validation.' END AS reason FROM documents")
def reviewed_decisions(spark, d):
    rows = rows_of(spark, d, f"SELECT doc_id AS id, {_dealt(_REVIEWS)} AS raw FROM documents")
    return rows.select("id", curation.normalized_decision(F.col("raw")).alias("v")).select("id", "v.decision", "v.reason")


_LOG = f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 11 = 1 THEN 'damaged {{' ELSE concat('{{\"source_path\": \"p', CAST(doc_id AS STRING), '\", \"decision\": ', coalesce(nullif({_dealt(_REVIEWS)}, 'none'), 'null'), '}}') END AS value FROM documents WHERE doc_id % 4 <> 0"


@query(
    """WITH l AS (SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 11 > 1 AS done FROM documents) SELECT doc_id AS id, CASE WHEN NOT done THEN 'left' ELSE 'accepted' END AS state, CASE WHEN done THEN 'Replace the latch of the door.' END AS resolution FROM l WHERE NOT done OR doc_id % 6 = 0
    UNION ALL SELECT CASE k WHEN 'reviewed' THEN -1 WHEN 'accepted' THEN -2 WHEN 'review' THEN -3 ELSE -4 END, k, CAST(n AS VARCHAR) FROM (SELECT 'reviewed' AS k, count(*) FILTER (done) AS n FROM l UNION ALL SELECT 'accepted', count(*) FILTER (done AND doc_id % 6 = 0) FROM l UNION ALL SELECT 'review', count(*) FILTER (done AND doc_id % 6 IN (1, 2, 4, 5)) FROM l UNION ALL SELECT 'rejected', count(*) FILTER (done AND doc_id % 6 = 3) FROM l)"""
)
def resumed_reviews(spark, d):
    """What a resumed review has left to do, what it had accepted, and its counts."""
    work = rows_of(spark, d, "SELECT concat('p', CAST(doc_id AS STRING)) AS path, doc_id AS id FROM documents")
    left, accepted, counts = curation.resumed(work, rows_of(spark, d, _LOG))
    of = F.expr("CAST(substring(path, 2) AS BIGINT)").alias("id")
    place = F.create_map(*(F.lit(x) for kv in (("reviewed", -1), ("accepted", -2), ("review", -3), ("rejected", -4)) for x in kv))
    shown = counts.unpivot([], ["reviewed", "accepted", "review", "rejected"], "state", "n").select(place[F.col("state")].cast("long").alias("id"), "state", F.col("n").cast("string").alias("resolution"))
    return left.select("id", F.lit("left").alias("state"), F.lit(None).cast("string").alias("resolution")).unionByName(accepted.select(of, F.lit("accepted").alias("state"), "resolution")).unionByName(shown)
