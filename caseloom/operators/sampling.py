"""Deterministic samples: stratified and even, seeded, and the audit's four slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bulletins as B


def even_per_stratum(rows: DataFrame, stratum: str, order: str, take: int) -> DataFrame:
    """At most `take` rows per stratum, evenly spaced over its order."""
    w = Window.partitionBy(stratum)
    r = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    r = r.withColumn("__k", F.least(F.lit(take), F.col("__n")))
    slot = F.ceil(F.col("__i") * F.col("__k") / F.col("__n"))
    return r.where((slot < F.col("__k")) & (F.floor(slot * F.col("__n") / F.col("__k")) == F.col("__i"))).drop("__i", "__n", "__k")


def lot(seed: int, id: str) -> Column:
    """A keyed order: MD5 of seed and id, which any engine has."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")).cast("binary"))


def seeded_per_stratum(rows: DataFrame, stratum: str, id: str, take: int, seed: int = 12345) -> DataFrame:
    """`take` rows per stratum by a keyed hash: the same rows on every run and every cluster."""
    w = Window.partitionBy(stratum).orderBy(lot(seed, id), id)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= take).drop("__n")


#: Names of makes, two of which in one case hint at mixed-up vehicles.
MAKES = (r"\baudi\b", r"\bbmw\b", r"\bcitro[eë]n\b", r"\bdacia\b", r"\bford\b", r"\bhyundai\b", r"\bkia\b", r"\bmercedes\b", r"\bnissan\b", r"\bopel\b", r"\bpeugeot\b", r"\brenault\b", r"\b(?:škoda|skoda)\b", r"\btesla\b", r"\btoyota\b", r"\b(?:volkswagen|vw)\b", r"\bvolvo\b", r"\bfiat\b", r"\bmazda\b", r"\bhonda\b")


def with_risk(cases: DataFrame, short: int = 60) -> DataFrame:
    """`cases` with risk 0..9 from description, resolution and the cited posts."""
    none = lambda c: (F.coalesce(F.size(c), F.lit(0)) <= 0).cast("int")
    both = F.concat_ws(" ", F.lit(""), "description", "resolution")
    # most texts name no make, which one pass tells
    makes = F.when(B.any_of(both, MAKES), sum((both.rlike("(?i)" + m).cast("int") for m in MAKES), F.lit(0))).otherwise(0)
    fix = F.trim(F.coalesce("resolution", F.lit("")))
    risk = (F.length(fix) < short).cast("int") * 3 + none("fix_posts") * 2 + none("fault_posts") + (makes >= 2).cast("int") * 2 + B.any_of(fix, (r"\b(?:clean|additiv|flush|reset|reflash|emulat)",)).cast("int")
    return cases.withColumn("risk", risk)


def audit_sample(pool: DataFrame, imported: DataFrame, audited: DataFrame, sample: int = 10, fresh: int = 3, risk: int = 4, random: int = 3, seed: int = 1) -> DataFrame:
    """(id, slice): newest imports, then the riskiest, then random ones, then the riskiest left.

    Rows not yet audited come first in each slice; an id is taken once; at most `sample` in all.
    `pool` and `imported`: id, created_at (pool: risk as well).  Each slice is a top-k of its own.
    """
    known = audited.select("id").distinct().withColumn("__aud", F.lit(1))
    new = imported.select("id", "created_at").dropDuplicates(["id"]).orderBy(F.desc_nulls_last("created_at"), "id").limit(min(fresh, sample)).select("id", F.lit("fresh").alias("slice"))
    left = pool.dropDuplicates(["id"]).join(new, "id", "left_anti").join(known, "id", "left").withColumn("__aud", F.coalesce("__aud", F.lit(0)))
    by_risk = [F.col("__aud"), F.desc("risk"), F.desc_nulls_last("created_at"), F.col("id")]
    risky = left.orderBy(*by_risk).limit(risk).select("id", F.lit("risk").alias("slice"))
    rest = left.join(risky, "id", "left_anti")
    # of unaudited rows alone, however few, if there are any: a count of at most one row
    unaudited = rest.where("__aud = 0").limit(1).agg(F.count(F.lit(1)).alias("__some"))
    eligible = rest.crossJoin(F.broadcast(unaudited)).where("__aud = 0 or __some = 0")
    drawn = eligible.orderBy(lot(seed, "id"), "id").limit(random).select("id", F.lit("random").alias("slice"))
    spill = rest.join(drawn, "id", "left_anti").orderBy(*by_risk).limit(sample).select("id", F.lit("spill").alias("slice"))
    order = F.array_position(F.array(*map(F.lit, ("fresh", "risk", "random", "spill"))), F.col("slice"))
    return new.unionByName(risky).unionByName(drawn).unionByName(spill).orderBy(order, "id").limit(sample)


def ring_buffer(ids: DataFrame, most: int = 500) -> DataFrame:
    """The last `most` of (seq, id)."""
    return ids.orderBy(F.desc("seq")).limit(most).orderBy("seq")


def calibration_sample(threads: DataFrame, n: int) -> DataFrame:
    """Threads (idx, signal) with a signal by strength, then the others in order; n of them."""
    return threads.orderBy((F.col("signal") > 0).desc(), F.when(F.col("signal") > 0, -F.col("signal")), "idx").limit(n)
