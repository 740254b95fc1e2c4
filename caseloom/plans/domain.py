"""The knowledge base's tables as views over the driver's, in SQL that both engines read alike.

Each entry is the text of a SELECT; queries and the SQL that checks them start from the same text.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MODELS = ("Octavia II (2006–2013)", "Octavia III", "Transit MK7 2.2 TDCi", "Mondeo MK III", "Almera N16", "Compass (2017–2024)", "3008", "Golf")
_MODEL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MODELS)) + " END"
_FAULT = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'other' ELSE concat('fault_', CAST(doc_id % 9 AS STRING)) END"

SQL = {
    "usage": "SELECT event_id AS id, user_id, event_type AS model, CAST(floor(value) AS BIGINT) AS input_tokens, event_id % 100 AS output_tokens, CAST(ts AS TIMESTAMP) AS created_at FROM events",
    "users": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat(lower(c_mktsegment), CAST(c_custkey % 10 AS STRING), '@example.com') END AS email FROM customer WHERE c_custkey % 4 <> 3",
    "signups": "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('u', CAST(event_id % 10 AS STRING), '@example.com') END AS email, CAST(ts AS TIMESTAMP) AS created_at FROM events WHERE event_type = 'signup'",
    "sessions": "SELECT o_orderkey AS id, o_custkey AS user_id, concat('{\"vehicle\": {\"brand\": \"', CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('Brand#', CAST(o_custkey % 25 + 1 AS STRING)) END, '\"}}') AS data, o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 2 DAY END AS TIMESTAMP) AS updated_at FROM orders",
    "closed": "SELECT l_orderkey AS id, p_brand AS vehicle_brand, CAST(l_shipdate AS TIMESTAMP) AS closed_at FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cases": f"SELECT CAST(doc_id AS STRING) AS id, source AS vehicle_brand, {_MODEL} AS vehicle_model, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST((doc_id * 7919) % 260000 AS INT) END AS mileage, CASE WHEN doc_id % 3 = 0 THEN '110 kW' ELSE '81 kW' END AS engine_power, text AS description, text AS resolution, CASE WHEN doc_id % 10 = 9 THEN 'rejected' WHEN doc_id % 10 = 8 THEN 'pending' ELSE 'approved' END AS status, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('TSB', CAST(doc_id % 50 AS STRING)) END AS source_ref, {_FAULT} AS canonical_fault_id, CASE WHEN doc_id % 6 = 0 THEN '2006' END AS vehicle_generation, doc_id % 997 AS age, doc_id FROM documents",
    "threads": "SELECT event_id AS id, concat('forum', CAST(user_id % 12 AS STRING)) AS forum_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'error' WHEN 'click' THEN 'discarded' WHEN 'signup' THEN 'deferred' ELSE 'extracted' END AS status, CASE WHEN event_type <> 'click' THEN NULL WHEN event_id % 4 = 0 THEN 'Too few posts (1)' WHEN event_id % 4 = 1 THEN 'classifier rejected' WHEN event_id % 4 = 2 THEN 'HTTP 503' ELSE 'extractor returned no cases' END AS discard_reason, CAST(ts AS DATE) AS night FROM events",
    "outcomes": "SELECT o_orderkey AS id, concat('forum', CAST(o_custkey % 15 AS STRING)) AS forum_id, CASE WHEN o_orderstatus = 'F' THEN 'imported' WHEN o_orderkey % 3 = 0 THEN 'verify_rejected' WHEN o_orderkey % 3 = 1 THEN 'verified' ELSE 'crosscheck_dupe' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'failed:same_vehicle' WHEN o_orderkey % 5 = 0 THEN 'Pre-gate: short' ELSE NULL END AS review_note FROM orders",
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view over the tables its text names behind FROM and JOIN."""
    return rows_of(spark, sf_dir, SQL[name])


def rows_of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a SELECT over the driver's tables that both engines read alike."""
    used = {t: table(spark, sf_dir, t) for t in re.findall(r"\b(?:FROM|JOIN) (\w+)", text)}
    text = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", text), **used)


def cte(*names: str) -> str:
    """The same views for the checking SQL: WITH usage AS (...), ..."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


def scratch(spark) -> str:
    """A new path in the folder all machines share; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.gettempdir()
    return f"{named.rstrip('/')}/caseloom-{uuid.uuid4().hex}"
