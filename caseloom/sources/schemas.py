"""Spark schemas of the knowledge base's tables."""

from __future__ import annotations

CASES = (
    "id string, local_id string, user_id string, vehicle_brand string, vehicle_model string, mileage int, engine_power string, "
    "symptoms array<string>, obd_codes array<string>, description string, resolution string, resolution_cs string, resolution_de string, "
    "resolution_lang string, closed_at timestamp, created_at timestamp, status string, thread_url string, source_ref string, "
    "canonical_fault_id string, vehicle_generation string, review_reason string, reviewed_at timestamp"
)
SESSIONS = "id string, user_id string, local_id string, data string, status string, created_at timestamp, updated_at timestamp"
USAGE = "id string, user_id string, model string, input_tokens int, output_tokens int, created_at timestamp"
USERS = "id string, email string, created_at timestamp"
TAXONOMY = "id string, label_cs string, label_en string, label_de string, category string, created_at timestamp"
CODES = "code string, brand_group string, description string, system string, common_causes string, severity string, source string"
SHARED = "id string, user_id string, session_id string, snapshot string, vehicle_summary string, fault_summary string, created_at timestamp"
FEEDBACK = "id string, message string, user_email string, lang string, created_at timestamp"
MANUAL_TEXT = "id string, manual_filename string, section_title string, repair_group string, pdf_page int, page_count int, extracted_pages int, content string, char_count int, created_at timestamp"
FORUMS = (
    "id string, name string, url string, brands array<string>, language string, status string, calibration_status string, priority_score double, "
    "yield_rate double, cooldown_until timestamp, cooldown_set_at timestamp, cooldown_tier_hours int, last_crawled_at timestamp, new_threads_last_batch int, public_readable boolean"
)
METRICS = "date date, scope string, metric string, value double, updated_at timestamp"
DAILY_REPORT = "date date, report_md string, metrics_json string"
REVIEW_QUEUE = (
    "case_local_id string, vehicle_brand string, vehicle_model string, clause string, ai_note string, evidence array<struct<post: int, author: string, text: string>>, "
    "thread_url string, created_at timestamp, resolved_at timestamp, decision string, decision_reason string, human_note string, candidate_confirmation string"
)
THREADS = "id string, forum_id string, url string, title string, status string, thread_text string, discard_reason string, attempts int, created_at timestamp, last_processed_at timestamp, revisit_after timestamp"
RUNS = "id long, started_at timestamp, ended_at timestamp, stop_reason string"
JOURNAL = "forum_id string, date date, knob string, direction string, old_priority double, new_priority double, old_tier int, new_tier int"
LABELS = "seq long, ts string, date date, case_id string, status string, forum_id string, slice string, wrongly_accepted boolean, confidence string, failed_condition string, reason string"
CATALOG = "market string, brand string, active boolean, idx int, `group` string, label string, powers array<string>"
SEED = (
    "seq long, stage string, vehicle_brand string, vehicle_model string, obd_codes array<string>, symptoms array<string>, description string, resolution string, "
    "source_ref string, model_year string, source_refs array<string>, model_years array<string>, model_raw_values array<string>, source_variant_count long, resolved boolean"
)
#: The positional columns of the bulletin feed, in order.
BULLETIN = "nhtsa_id replacement_bulletin date_added tsb_id mfr_comm_date mfr_internal_campaign communication_type make model model_year nhtsa_components mfr_component_system mfr_component_subsystem summary".split()

#: Rules that rows of a table must keep, as SQL conditions.
RULES = {
    "cases": {"resolution_length": "length(resolution) between 10 and 400", "status": "status in ('pending', 'approved', 'rejected')"},
    "sessions": {"status": "status in ('open', 'closed', 'archived')"},
}
UNIQUE = {"sessions": ("user_id", "local_id"), "metrics": ("date", "scope", "metric"), "codes": ("code", "coalesce(brand_group, '__generic__')"), "journal": ("date", "forum_id")}
