"""Scored retrieval of similar cases, for any number of questions in one job.

`questions`: query_id, brand, model, engine, mileage, codes, symptoms, text.  `cases`: as in
`caseloom.sources.schemas.CASES`.  Questions meet cases by brand (an equi-join, so a hot brand can
be split at run time); each signal keeps its newest few per question by a ranking that Spark cuts
before the shuffle, and everything later is per question and bounded by those few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S

#: Newest candidates per signal and how many answers are returned.
NEWEST, BY_CODE, BY_MODEL, ANSWERS = 200, 150, 100, 5


def family_prefix(model: Column) -> Column:
    """First word of a model, without what a pattern would treat as a wildcard."""
    return F.lower(F.regexp_replace(F.get(F.split(F.trim(F.coalesce(model, F.lit(""))), rf"{S.SPACE}+"), 0), "[%_]", ""))


def candidates(cases: DataFrame, questions: DataFrame) -> DataFrame:
    """Each question's candidates once: newest of the brand, then by code, then by model family."""
    approved = cases.where("status = 'approved'").select(F.struct(*cases.columns).alias("c"), F.col("vehicle_brand").alias("__brand"))
    asked = questions.where(S.given(F.col("brand"))).select(F.struct(*questions.columns).alias("q"))
    met = asked.join(approved, F.col("q.brand") == F.col("__brand")).drop("__brand")
    prefix = family_prefix(F.col("q.model"))
    signals = (
        (NEWEST, F.lit(True)),
        (BY_CODE, F.coalesce(F.arrays_overlap("q.codes", "c.obd_codes"), F.lit(False))),
        (BY_MODEL, (prefix != "") & F.startswith(F.lower("c.vehicle_model"), prefix)),
    )
    newest = [F.col("c.closed_at").desc_nulls_first(), F.col("c.id")]
    branches = []
    for source, (limit, holds) in enumerate(signals):
        ranked = met.where(holds).withColumn("pos", F.row_number().over(Window.partitionBy("q.query_id").orderBy(*newest)))
        branches.append(ranked.where(F.col("pos") <= limit).withColumn("src", F.lit(source)))
    union = branches[0].unionByName(branches[1]).unionByName(branches[2])
    first = Window.partitionBy("q.query_id", "c.id").orderBy("src", "pos")
    return union.where(F.col("c.id").isNotNull()).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def scored(met: DataFrame) -> DataFrame:
    q = {k: F.col(f"q.{k}") for k in ("model", "engine", "mileage", "codes", "symptoms", "text")}
    c = {"model": "vehicle_model", "engine": "engine_power", "mileage": "mileage", "codes": "obd_codes", "symptoms": "symptoms", "text": "description"}
    c = {k: F.col(f"c.{v}") for k, v in c.items()}
    rows = met.withColumn("score", S.agreement(q, c)).withColumn("most_asked", S.most_score(**q)).withColumn("most_held", S.most_score(**c))
    rows = rows.withColumn("ratio", S.f1(F.col("score"), F.col("most_asked"), F.col("most_held")))
    held = S.passes(F.col("score"), F.col("ratio"), F.col("most_asked")) & ~S.suppressed(F.col("c.thread_url"), F.col("c.description"), F.col("c.symptoms"))
    return rows.where(held)


def search(cases: DataFrame, questions: DataFrame, answers: int = ANSWERS) -> DataFrame:
    """query_id, rank, the case, score, ratio, confirmations and strength of up to `answers` answers.

    An answer is skipped if its canonical key, or its classified fault, was already *taken*; a row
    skipped by key doesn't claim its fault, so this walks the question's ranked rows in order, over
    an array of a few hundred small structs.
    """
    rows = scored(candidates(cases, questions))
    rows = rows.withColumn("fault", S.fault_key(F.col("c.canonical_fault_id"))).withColumn("origin", F.coalesce(F.nullif(F.trim("c.source_ref"), F.lit("")), F.col("c.id")))
    same = Window.partitionBy("q.query_id", "fault")
    rows = rows.withColumn("confirmed", F.when(F.col("fault").isNull(), 1).otherwise(F.size(F.collect_set("origin").over(same))))
    key = S.canonical_key(*(F.col(f"c.{x}") for x in ("source_ref", "vehicle_brand", "vehicle_model", "obd_codes", "description", "resolution")))
    order = F.struct(
        (-F.col("ratio") * S.confirmation_bonus(F.col("confirmed"))).alias("boosted"),
        (-F.col("score")).alias("by_score"),
        (-F.col("ratio")).alias("by_ratio"),
        "src",
        "pos",
        F.sha2(key, 256).alias("key"),
        "fault",
        F.col("c.id").alias("id"),
        "score",
        "ratio",
        "confirmed",
    )
    ranked = rows.groupBy(F.col("q.query_id").alias("query_id")).agg(F.array_sort(F.collect_list(order)).alias("ranked"))
    kind = ranked.schema["ranked"].dataType.simpleString()

    def walk(taken: Column, row: Column) -> Column:
        seen = F.exists(taken, lambda t: (t["key"] == row["key"]) | (t["fault"] == row["fault"]))
        return F.when((F.size(taken) >= answers) | F.coalesce(seen, F.lit(False)), taken).otherwise(F.concat(taken, F.array(row)))

    picked = ranked.select("query_id", F.posexplode(F.aggregate("ranked", F.array().cast(kind), walk)).alias("rank", "hit"))
    return picked.select("query_id", (F.col("rank") + 1).alias("rank"), "hit.id", "hit.score", "hit.ratio", "hit.confirmed", S.strength(F.col("hit.ratio"), F.col("hit.score")).alias("strength"))
