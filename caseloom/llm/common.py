"""What the operators share: reading, durable tables in the shared folder, hashing helpers.

Nothing here collects rows.  `durable` is the only place that writes: it puts a table under the
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a reread and
never a recomputation of what came before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as Java regular expressions write it: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the cluster names none, one of our own in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = getattr(shared_dir, "own", None)
        if named is None:
            shared_dir.own = named = tempfile.mkdtemp(prefix="caseloom-")
    return named.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/caseloom/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a table in the shared folder, read back with its schema.

    Unlike a checkpoint the result carries no partitioning, so a later join exchanges both sides
    and adaptive execution can split a hot key.
    """
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blank(text: Column | str) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def mark(*cols: Column, seed: int) -> Column:
    """60 bits from MD5 over the seed and the columns as text (null as -), which any engine has."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def uniform(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) from a keyed hash: the same on every run and in every partitioning."""
    return F.shiftright(mark(*cols, seed=seed), 8).cast("double") * F.lit(2.0**-52)


def row_key(docs: DataFrame) -> Column:
    """SHA-256 over all columns of a row: the same on every run, and equal for equal rows only."""
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("-")), rest), 256))
