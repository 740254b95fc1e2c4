"""Readers: bulletin feeds, JSON seeds, logs, CSV reports.  All are splittable and push filters down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import BULLETIN, SEED

BOM = "﻿"


def bulletins(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records of 14 columns; shorter lines go, further tabs belong to the last column."""
    parts = F.split("value", "\t", len(BULLETIN))
    rows = spark.read.text(path).select(parts.alias("p"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where(F.size("p") >= len(BULLETIN))
    return rows.select(*(F.trim(F.col("p")[i]).alias(c) for i, c in enumerate(BULLETIN)), "file", "block")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BOM}", "")


def seeds(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """One JSON document per file, with or without a byte-order mark, from a folder tree."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", names).option("recursiveFileLookup", True).text(path)
    return files.select(F.from_json(without_bom(F.col("value")), SEED).alias("s"), F.col("_metadata.file_path").alias("file")).where("s is not null").select("s.*", "file")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Log rows; malformed lines go, or fail the read if `strict`."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Quoted fields may hold separators, quotes and line ends; the first row names the columns."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def scan(spark: SparkSession, path: str, columns: list[str], since: str | None = None, at: str = "created_at", **equal) -> DataFrame:
    """A pruned, filtered scan; paging is the engine's business."""
    rows = spark.read.parquet(path)
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return (rows.where(F.col(at) >= F.lit(since).cast("timestamp")) if since else rows).select(*columns)


def filtered(rows: DataFrame, **given) -> DataFrame:
    """Conditions for the arguments that are given; a list means any of its members."""
    for c, v in given.items():
        if v is not None:
            rows = rows.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return rows


def unfinished(work: DataFrame, log: DataFrame, key: str = "path") -> DataFrame:
    """Work that a decision log hasn't recorded: what a resumed run has left to do."""
    return work.join(log.select(key).distinct(), key, "left_anti")


def retry_files(log: DataFrame) -> DataFrame:
    return log.where("status = 'error'").select("file").distinct().orderBy("file")


def supported_makes(feed: DataFrame, known: DataFrame, samples: int = 8) -> DataFrame:
    """Rows per make with up to `samples` model names and whether the catalog has it."""
    makes = feed.where("make <> ''").groupBy(F.upper("make").alias("make")).agg(F.count(F.lit(1)).alias("rows"), F.slice(F.array_sort(F.collect_set("model")), 1, samples).alias("models"))
    have = known.select(F.upper("make").alias("make")).distinct().withColumn("supported", F.lit(True))
    return makes.join(have, "make", "left").withColumn("supported", F.coalesce("supported", F.lit(False))).orderBy(F.desc("rows"), "make")


def merged_records(feed: DataFrame, key: list[str], lists: list[str], order: str) -> DataFrame:
    """Feed rows of one key as one: the first row's values, the union of its comma lists."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    others = [c for c in feed.columns if c not in key and c not in lists]
    first = F.min_by(F.struct(*others), order).alias("f")
    union = [F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, split(c).alias("v")))), lambda x: x["v"]))), ", ").alias(c) for c in lists]
    return feed.groupBy(*key).agg(first, *union).select(*key, "f.*", *lists)


def pattern_groups(records: DataFrame, key: list[str]) -> DataFrame:
    """Groups of records that read the same: a representative, their models and years, how many."""
    return records.groupBy(*key).agg(F.min_by(F.struct(*records.columns), "seq").alias("first"), F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("model_year")).alias("years"), F.count(F.lit(1)).alias("n"))
