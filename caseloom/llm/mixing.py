"""Operator 10, mixing sources to target weights.

Words per source are summed (partial aggregation; one row per source is all that meets), the
targets are shared out over that small table with windows, and each document is then emitted
floor(rate) times plus one more copy with a probability that equals the rate's fraction.
Nothing is collected: the source table is joined back, broadcast by Spark only if it is small.

The extra copies are hash-seeded Bernoulli draws, made in strata.  Drawn one by one, a few of the
longest documents decide how far a source ends from its target.  So a source's documents are dealt
by hash into strata of about STRATUM rows and stand there by size, and one keyed uniform number u of
the stratum draws them all: the document in place r has one more copy if a whole number lies in
(fraction * (r - 1) + u, fraction * r + u].  Each draw alone is Bernoulli with that fraction, while
neighbours in size balance each other: a stratum misses its share by about one document at most.

Equal rows are counted before anything is dealt, and go to the strata in chunks of CHUNK rows, so that
rows of which a third are equal fill all strata alike.  Texts take no part in that: only a row's key,
its source, its size and its number do.  A mix then takes each distinct row once, by its key, and
repeats it as often as its chunks say.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, of all words; a target stops at
`most` times its source's size and what is over goes to the others by weight, again and again.  That
ends at target = min(most * size, level * weight), and the level follows in closed form from sums
over the sources in order of size / weight.

Edge cases: a null text has size 0; a null source is a source of its own, in the last place; a null
doc_id is hashed as such; rows that are equal throughout are interchangeable; a source without words has target 0
and gives nothing; an empty table gives an empty result; other columns pass through or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blank, durable, mark, row_key, uniform

#: The weights that sources take in turn, and the cap on a target.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 20_240_229
STRATUM = 4096
CHUNK = 64  # equal rows that are dealt together


def words(text: Column | str) -> Column:
    return F.regexp_count(blank(text), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: __source, __source_size, __target, __rows, from rows with __source, __size and, if they stand for several, __rows."""
    rows = F.sum("__rows") if "__rows" in sized.columns else F.count(F.lit(1))
    per = sized.groupBy("__source").agg(F.sum("__size").alias("__source_size"), rows.alias("__rows"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("__w", weight).withColumn("__cap", most * F.col("__source_size"))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("__source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    per = per.withColumn("__level", level)
    # the level of the first source that its cap doesn't stop holds for all behind it
    holds = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), "__level"))).over(everything)
    share = F.coalesce(F.least(F.col("__cap"), holds["__level"] * F.col("__w")), F.col("__cap"))
    return per.select("__source", "__source_size", share.cast("double").alias("__target"), "__rows")


def drawn(classes: DataFrame, seed: int = SEED, stratum: int = STRATUM, chunk: int = CHUNK) -> DataFrame:
    """`classes` (key columns, __source, __size, __id, __digest, __n) in chunks of at most `chunk` of their __n equal rows.

    Adds __source_size, __target, __m (rows of the chunk), __whole, and __fraction, __u and __start, which say how many
    of the chunk's first rows have one more copy; see `more`.
    """
    rows = classes.groupBy("__source", "__size").agg(F.sum("__n").alias("__rows"))
    sums = rows.select("__source", (F.col("__size") * F.col("__rows")).alias("__size"), "__rows")
    per = durable(targets(sums)).withColumnRenamed("__source", "__of")
    each = classes.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))))
    each = each.withColumn("__m", F.least(F.lit(chunk), F.col("__n") - chunk * F.col("__j")))
    # the same on every run and in every partitioning: it depends on the rows alone
    each = each.withColumn("__hash", mark(F.col("__id"), F.col("__digest"), F.col("__j"), seed=seed))
    joined = each.join(per, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("__rate", rate).withColumn("__stratum", F.pmod("__hash", F.ceil(F.col("__rows") / F.lit(stratum))))
    by_size = Window.partitionBy("__source", "__stratum").orderBy(F.desc("__size"), "__hash", "__id").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("__start", F.sum("__m").over(by_size) - F.col("__m"))
    whole = F.floor("__rate")
    return placed.withColumns({"__whole": whole, "__fraction": F.col("__rate") - whole, "__u": uniform(F.col("__source"), F.col("__stratum"), seed=seed)})


def more(first: Column, last: Column) -> Column:
    """How many of a chunk's rows first + 1 to last have one more copy."""
    at = lambda i: F.floor(F.col("__fraction") * (F.col("__start") + i) + F.col("__u"))
    return at(last) - at(first)


def rates(docs: DataFrame, seed: int = SEED, stratum: int = STRATUM) -> DataFrame:
    """doc_id, source, __size, __source_size, __target and __copies, one row per row of `docs`."""
    digest = F.md5(F.col("text").cast("binary"))
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), words("text").alias("__size"), digest.alias("__digest"))
    classes = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    each = drawn(classes, seed, stratum).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    return each.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), "__size", "__source_size", "__target", (F.col("__whole") + more(F.col("__i") - 1, F.col("__i"))).alias("__copies"))


def mix(docs: DataFrame, seed: int = SEED, stratum: int = STRATUM) -> DataFrame:
    """The mixed documents: each row as many times as it is drawn, columns as in `docs`, whatever their names."""
    own = lambda c: F.col(f"`{c}`")
    whole = F.struct(*(own(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    keyed = docs.select(row_key(docs).alias("__key"), own("doc_id").alias("__id"), own("source").alias("__source"), words(own("text")).alias("__size"), whole.alias("__row"))
    classes = keyed.groupBy("__key", "__id", "__source", "__size").agg(F.count(F.lit(1)).alias("__n")).withColumn("__digest", F.hex("__key"))
    chunks = drawn(durable(classes), seed, stratum)
    copies = chunks.select("__key", (F.col("__m") * F.col("__whole") + more(F.lit(0), F.col("__m"))).alias("__copies")).where("__copies > 0")
    once = keyed.groupBy("__key").agg(F.first("__row").alias("__row"))
    met = once.join(copies, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return met.select(*(F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
