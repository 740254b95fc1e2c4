"""Streams with state against their batch forms: disorder, late and repeated rows, a restart."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.streaming import stateful

START = 1_700_000_000_000_000
HOUR = stateful.HOUR


@pytest.fixture
def stored(spark):
    for k, v in stateful.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in stateful.STORE:
        spark.conf.unset(k)


def replay(spark, tmp_path, schema, parts, f):
    """What the stream gives over files of rows, lost and resumed between them."""
    out = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("when", F.timestamp_micros("us")))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        out.append(n)
    return sorted(repr(tuple(r)) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def batch(spark, schema, rows, f):
    return sorted(repr(tuple(r)) for r in f(spark.createDataFrame(rows, schema).withColumn("when", F.timestamp_micros("us"))).collect())


def disordered(rows, seed, late):
    """The rows in three parts, each row displaced by less than the watermark waits, some repeated."""
    rng = random.Random(seed)
    moved = sorted(rows, key=lambda r: r[-1] + rng.random() * late)
    moved += rng.sample(moved[-20:], 10)
    third = len(moved) // 3
    return [moved[:third], moved[third : 2 * third], moved[2 * third :]]


def test_calls_in_the_last_hours(stored, tmp_path):
    rng = random.Random(1)
    schema = "id long, user string, us long"
    rows = [(k, f"u{min(3, int(rng.expovariate(0.8)))}", START + rng.randrange(90 * HOUR)) for k in range(250)]
    rows += [(1000 + k, "u0", START + 10 * HOUR) for k in range(5)]  # of one moment
    parts = disordered(rows, 2, HOUR // 2)
    end = [(9999, "end", START + 900 * HOUR)]
    late = [(7777, "u0", START + HOUR)]  # the watermark is days behind it
    f = lambda df: stateful.limited(df.select("id", F.col("user").alias("user_id"), F.col("when").alias("created_at")), 24, 40)
    got = replay(stored, tmp_path, schema, [*parts[:2], parts[2] + end, late, [(9998, "end", START + 990 * HOUR)]], f)
    want = [r for r in batch(stored, schema, rows + end, f)]
    assert got == want and any("True" in r for r in want)


def test_lives_of_cases(stored, tmp_path):
    rng = random.Random(3)
    schema = "id long, case string, to string, us long"
    names = [*stateful.NEXT, "crosscheck_dupe", "quarantined", "verify_rejected", "nonsense"]
    rows = [(k, f"c{rng.randrange(12)}", rng.choice(names), START + rng.randrange(60) * HOUR) for k in range(300)]
    parts = disordered(rows, 4, HOUR // 2)
    f = lambda df: stateful.lives(df.select("id", F.col("case").alias("case_id"), "to", F.col("when").alias("changed_at")))
    end = (9999, "end", "verified", START + 900 * HOUR)
    got = replay(stored, tmp_path, schema, [parts[0], parts[1], [*parts[2], end], [(9998, "end", "verified", START + 990 * HOUR)]], f)
    assert got == batch(stored, schema, [*rows, end], f) and sum("True" in r for r in got) > 15


def test_quiet_threads(stored, tmp_path):
    rng = random.Random(5)
    schema = "id string, us long"
    day = 24 * HOUR
    rows = [(f"t{rng.randrange(6)}", START + rng.randrange(80) * day + rng.randrange(day)) for _ in range(60)]
    rows += [("lone", START), ("twice", START), ("twice", START + 10 * day)]  # quiet for exactly as long in between
    moved = sorted(rows, key=lambda r: r[1] + rng.random() * day / 2)
    last = START + 400 * day
    f = lambda df, **o: stateful.quiet(df.select("id", F.col("when").alias("last_activity")), 10, **o)
    got = replay(stored, tmp_path, schema, [moved[:20], moved[20:45], [*moved[45:], ("end", last)], [("end", last + day)]], f)
    until = F.timestamp_micros(F.lit(last - day))
    assert got == batch(stored, schema, rows, lambda df: f(df, until=until)) and len(got) > 8
