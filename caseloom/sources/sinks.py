"""Sinks: upserts by rewrite, appends without repeats, staged output, snapshots.

Without a table format an upsert reads the old version, writes a new one next to it, and swaps a
pointer; one writer at a time.  `merge` and `upsert` are the pure parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of both, those of `new` in place of old ones with their key; the latest `version` wins within."""
    rows = new
    if version:
        latest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version))
        rows = new.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    met = rows.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return old.join(met, on, "left_anti").unionByName(rows.select(*old.columns))


def merge(old: DataFrame, new: DataFrame, keys: list[str], patch: list[str]) -> DataFrame:
    """Insert new keys; of known ones only the `patch` columns change, and never to null."""
    n = new.select(*(F.col(c).alias(f"__{c}") for c in new.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = old.withColumn("__old", F.lit(True)).join(n.withColumn("__new", F.lit(True)), on, "full")
    value = lambda c: F.when(F.col("__old").isNull(), F.col(f"__{c}")).when(F.lit(c in patch), F.coalesce(f"__{c}", c)).otherwise(F.col(c)) if f"__{c}" in n.columns else F.col(c)
    return met.select(*(value(c).alias(c) for c in old.columns))


def missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` to append: keys that `old` lacks (null equals null), each once."""
    first = new.dropDuplicates(keys)
    return upsert(first, old.select(*keys).distinct(), keys).select(*new.columns) if set(keys) == set(new.columns) else first.join(old.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct(), _same(keys), "left_anti")


def _same(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return on


def shared_snapshot(old: DataFrame, asked: DataFrame) -> DataFrame:
    """Snapshots to insert for (user_id, session_id) that have none, summaries cut to their limits."""
    new = asked.dropDuplicates(["user_id", "session_id"]).join(old.select("user_id", "session_id"), ["user_id", "session_id"], "left_anti")
    return new.withColumns({"vehicle_summary": F.substring("vehicle_summary", 1, 200), "fault_summary": F.substring("fault_summary", 1, 300)})


def staged(rows: DataFrame, path: str, stage: str = "stage") -> None:
    rows.write.mode("overwrite").partitionBy(stage).json(path)


def stage_summary(rows: DataFrame, stage: str = "stage") -> DataFrame:
    return rows.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))


def reports(rows: DataFrame, path: str) -> None:
    """The same rows as CSV and as JSON lines."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def _versions(spark: SparkSession, table: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("v-")) for n in names if n.startswith("v-") and n[2:].isdigit())


def has_version(spark: SparkSession, table: str) -> bool:
    return bool(_versions(spark, table))


def write_version(rows: DataFrame, table: str, by: str | None = None) -> str:
    """Write a new version of a table and make it the current one by a single rename.

    A version is written under another name and renamed to the next number once it is whole; the
    highest number is current.  Nothing is ever deleted or replaced, so a run that is lost at any
    point leaves the table as it was, and of two writers at once one fails.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    known = _versions(spark, table)
    working, version = f"{table}/.next-{uuid.uuid4().hex}", f"{table}/v-{(known[-1] if known else 0) + 1:012d}"
    (rows.write.partitionBy(by) if by else rows.write).parquet(working)
    fs = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(version)) or not fs.rename(path(working), path(version)):
        raise OSError(f"can't make {version} current")
    return version


def read_current(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table}/v-{_versions(spark, table)[-1]:012d}")


def all_versions(spark: SparkSession, table: str) -> list[str]:
    """The versions of a table that only grows, in order."""
    return [f"{table}/v-{v:012d}" for v in _versions(spark, table)]


def violations(rows: DataFrame, rules: dict[str, str], key: tuple[str, ...] = ()) -> DataFrame:
    """(rule, n): how many rows break each rule, and how many keys repeat."""
    counts = rows.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()))
    out = counts.unpivot([], list(rules), "rule", "n")
    if key:
        again = rows.groupBy(*(F.expr(k).alias(f"k{i}") for i, k in enumerate(key))).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(again.select(F.lit("unique").alias("rule"), "n"))
    return out
