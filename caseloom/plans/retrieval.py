"""Ranked full-text search over an index table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest, symptoms, textindex
from ..sources import sinks
from .domain import scratch, table

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
    r"""WITH w AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY 1, 2),
    l AS (SELECT d.doc_id AS doc, coalesce(c.n, 0) AS length FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc, count(*) AS n FROM w GROUP BY 1) c ON d.doc_id = c.doc), s AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
    i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, n), q AS (SELECT DISTINCT doc AS query_id, term FROM w WHERE doc % 50 = 0),
    c AS (SELECT query_id, p.doc, round(sum(idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM q JOIN i USING (term) JOIN p USING (term) JOIN l ON p.doc = l.doc, s GROUP BY 1, 2)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank, doc, score FROM c WHERE score > 0.3 QUALIFY rank <= 20"""
)
def ranked_search(spark, d):
    """Every document whose id is divisible by 50 as a question, against the index of all; a named index is kept and extended."""
    path = spark.conf.get("spark.caseloom.text.index", None) or scratch(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    if not sinks.has_version(spark, path) or docs.join(textindex.read(spark, path).where("bucket = -1"), "doc", "left_anti").where("doc is not null").limit(1).count():
        textindex.add(docs, path)
    asked = docs.where("doc % 50 = 0").select(F.col("doc").alias("query_id"), F.col("text").alias("term"))
    return textindex.search(asked, path)


_TOKENS = "list_distinct(flatten([CASE WHEN regexp_matches(w, '^([0-9]+[a-z]+|[a-z]+[0-9]+)$') THEN [w, regexp_extract(w, '^([0-9]+|[a-z]+)', 1), regexp_extract(w, '([0-9]+|[a-z]+)$', 1)] ELSE [w] END FOR w IN regexp_extract_all(lower(strip_accents({0})), '[a-z0-9]+')]))"
_SENTENCES = "list_filter([trim(s) FOR s IN string_split_regex(coalesce(text, ''), '[.\\n]')], lambda s: s <> '')"


@query(
    f"""WITH d AS (SELECT doc_id, list_concat([concat('K', CAST(doc_id - doc_id % 50 AS VARCHAR))], {_SENTENCES}) AS s FROM documents), u AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS pos FROM d),
    l AS (SELECT concat('k', CAST(doc_id AS VARCHAR)) AS key, s[2] AS label, doc_id AS place FROM d WHERE doc_id % 50 = 0 AND len(s) > 1), o AS (SELECT label, min(place) AS place, {_TOKENS.format('label')} AS lw FROM l GROUP BY 1),
    t AS (SELECT text, {_TOKENS.format('text')} AS tw FROM (SELECT DISTINCT text FROM u)), p AS (SELECT text, label, place, len(list_intersect(tw, lw)) / len(list_distinct(list_concat(tw, lw))) AS score FROM t JOIN o ON len(tw) > 0 AND len(lw) > 0),
    b AS (SELECT text, label FROM p WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, place) = 1),
    n AS (SELECT doc_id, pos, coalesce(l.label, b.label, u.text) AS name FROM u LEFT JOIN l ON lower(u.text) = l.key LEFT JOIN b ON u.text = b.text), f AS (SELECT doc_id, name, min(pos) AS pos FROM n GROUP BY 1, 2)
    SELECT doc_id AS id, count(*) AS n, md5(string_agg(name, '|' ORDER BY pos)) AS names_md5 FROM f GROUP BY 1"""
)
def canonical_symptoms(spark, d):
    """Every sentence of the documents as a symptom; the first ones of those divisible by 50 are the taxonomy."""
    docs = table(spark, d, "documents").select("doc_id", symptoms.sentences(F.col("text")).alias("s"))
    key = F.concat(F.lit("K"), (F.col("doc_id") - F.col("doc_id") % 50).cast("string"))
    cases = docs.select(F.col("doc_id").alias("id"), F.concat(F.array(key), F.col("s")).alias("symptoms"))
    taxonomy = docs.where("doc_id % 50 = 0 and size(s) > 0").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.col("s")[0].alias("label"), F.col("doc_id").alias("place"))
    found = symptoms.canonical_symptoms(cases, taxonomy)
    return found.select("id", F.size("symptoms").cast("long").alias("n"), F.md5(F.array_join("symptoms", "|").cast("binary")).alias("names_md5"))


@query(
    """WITH b AS (SELECT c_mktsegment AS make, count(*) AS n, count(*) FILTER (c_acctbal > 0 AND c_nationkey < 20) AS kept FROM customer GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, make) <= 3 AS run FROM b)
    SELECT lower(make) AS brand, CASE WHEN run THEN 'refined_done' ELSE 'discovered' END AS status, CAST(CASE WHEN run THEN 5 ELSE 1 END AS BIGINT) AS version, CASE WHEN run THEN kept END AS kept FROM p"""
)
def brand_runs(spark, d):
    """Three runs, each of which claims the next brand and takes it through two stages of a durable manifest."""
    root = scratch(spark)
    customers = table(spark, d, "customer")
    manifest.discover(spark, root, customers.groupBy(F.col("c_mktsegment").alias("make")).agg(F.count(F.lit(1)).alias("supported_rows")))
    stages = {"discovered": lambda spark, state, rows: rows.where("c_acctbal > 0"), "coarse_done": lambda spark, state, rows: rows.where("c_nationkey < 20")}
    for run in ("a", "b", "c"):
        manifest.advance(spark, root, manifest.claim(spark, root, run), stages, lambda state: customers.where(F.col("c_mktsegment") == state["make"]))
    states = manifest.states(spark, root)
    outputs = [r["output"] for r in states.where("output is not null").select("output").collect()]  # of three brands
    kept = spark.read.parquet(*outputs).groupBy(F.lower("c_mktsegment").alias("of")).agg(F.count(F.lit(1)).alias("kept"))
    return states.join(kept, F.col("brand") == F.col("of"), "left").select("brand", "status", "version", "kept")
