"""The numbered operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, language, media, mixing, negatives, oracle, packing, private, quality, secrets, sharding, simhash, toxicity, whitening
from .common import fresh, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = spark.conf.get("spark.caseloom.secrets.ledger", None) or fresh(spark)
    return secrets.scan_paths(read(spark, sf_dir, "documents"), ledger).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).drop("number")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.grade(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.caseloom.private.key", "an example: set a secret one")
    return private.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), key, "n_entities")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.rates(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return drawn.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The other queries hold XXH64 votes, models, a tokenizer, keyed surrogates or zlib: tests/llm has them by hand."""
    return oracle.sql()
