"""Record linkage to a vehicle catalog, by exact keys, word overlap and year ranges.

The catalog is a dictionary of some thousand labels; Spark broadcasts it when its statistics say it
is small, and joins by brand otherwise.  Scores are structs, so that "best" is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bulletins as B
from ..functions import text as T

#: Alias keys of makes and the brands they mean.
BRAND_ALIASES = {"HUMMER": ["Hummer"], "MAYBACH": ["Maybach"], "MERCEDES": ["Mercedes-Benz"], "MERCEDES MAYBACH": ["Mercedes-Benz"], "SCION": ["Scion"], "SMART": ["Smart"]}


def catalog_index(catalog: DataFrame) -> DataFrame:
    """One row per label of `catalog` (market, brand, idx, group, label), headings carried forward."""
    forward = Window.partitionBy("market", "brand").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = catalog.withColumn("group", F.last(F.nullif("group", F.lit("")), ignorenulls=True).over(forward)).where("label is not null and label <> ''")
    base = B.label_base(F.col("label"))
    rows = rows.withColumn("group", F.coalesce("group", base))
    words = lambda c: F.filter(F.split(B.comparable(c), " "), lambda t: t != "")
    return rows.select("market", "brand", "group", "label", B.comparable(F.col("brand")).alias("brand_key"), B.comparable(F.col("group")).alias("group_key"), B.comparable(base).alias("label_key"), words(F.col("group")).alias("group_words"), words(base).alias("label_words"), B.label_years(F.col("label")).alias("years"))


def candidate_brands(makes: DataFrame, index: DataFrame) -> DataFrame:
    """(make, brand, brand_priority): by key, else by alias; a US entry comes first."""
    brands = index.select("brand", "brand_key").distinct()
    keyed = makes.select("make").distinct().withColumn("brand_key", B.comparable(F.col("make")))
    direct = keyed.join(brands, "brand_key").select("make", "brand")
    alias = F.create_map(*(x for k, v in BRAND_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    other = keyed.join(direct.select("make").distinct(), "make", "left_anti").select("make", F.explode(F.try_element_at(alias, F.col("brand_key"))).alias("brand"))
    order = Window.partitionBy("make").orderBy(~F.col("brand").rlike(r"(?i)\(US\)"), F.lower("brand"), "brand")
    return direct.unionByName(other.join(brands.select("brand"), "brand", "left_semi")).distinct().withColumn("brand_priority", F.row_number().over(order) - 1)


def resolve(records: DataFrame, index: DataFrame) -> DataFrame:
    """`records` (id, make, models: candidate names in order, year) with their catalog entry or nulls.

    An entry must have the model's key, or all of its two or more words, in label or group, and the
    year in its range; the least (brand, kind of match, model, span, label length, label) wins.
    """
    brands = candidate_brands(records, index)
    asked = records.select("id", "make", "year", F.posexplode("models").alias("model_priority", "model"))
    asked = asked.withColumn("key", B.comparable(F.col("model"))).withColumn("words", F.filter(F.split("key", " "), lambda t: t != ""))
    met = asked.join(brands, "make").join(index, "brand")
    several = F.size("words") >= 2
    subset = lambda c: several & (F.size(F.array_except("words", c)) == 0)
    kind = F.when(F.col("label_key") == F.col("key"), 0).when(F.col("group_key") == F.col("key"), 1).when(subset("label_words"), 2).when(subset("group_words"), 3)
    in_years = F.col("years").isNull() | F.col("year").isNull() | (F.col("year") <= 0) | F.col("year").between(F.col("years.start"), F.col("years.end"))
    met = met.withColumn("kind", kind).where(F.col("kind").isNotNull() & in_years)
    span = F.coalesce(F.col("years.end") - F.col("years.start"), F.lit(B.OPEN_END))
    score = F.struct("brand_priority", "kind", "model_priority", span.alias("span"), F.length("label").alias("n"), "label")
    best = met.groupBy("id").agg(F.min_by(F.struct("market", "brand", "label", "group"), score).alias("m"))
    return records.join(best, "id", "left").select(*(records[c] for c in records.columns), F.col("m").isNotNull().alias("resolved"), *(F.col(f"m.{c}").alias(f"matched_{c}") for c in ("market", "brand", "label", "group")))


def overlap_tokens(text: Column) -> Column:
    """Words of a name; 20tdi also as 20 and tdi, tdi20 as tdi and 20."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")
    parts = F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+[a-z]+$|^[a-z]+[0-9]+$"), F.array(w, F.regexp_extract(w, "^([0-9]+|[a-z]+)", 1), F.regexp_extract(w, "([0-9]+|[a-z]+)$", 1))).otherwise(F.array(w))))
    return F.array_distinct(parts)


def best_unambiguous(queries: DataFrame, entries: DataFrame, least: float, within: float, on: list[str] | None = None) -> DataFrame:
    """`queries` (id, text, ...) with the entry (name) of highest word overlap, null if ambiguous.

    Candidates share a word (an equi-join on words), as no other has an overlap above zero.  Null if
    the best is below `least` or another is `within` it.
    """
    on = on or []
    q = queries.select("id", *on, overlap_tokens(F.col("text")).alias("qt"))
    e = entries.select("name", *on, overlap_tokens(F.col("name")).alias("et")).distinct()
    pairs = q.withColumn("w", F.explode("qt")).join(e.withColumn("w", F.explode("et")), ["w", *on]).select("id", "name", "qt", "et").dropDuplicates(["id", "name"])
    scored = pairs.select("id", "name", T.jaccard(F.col("qt"), F.col("et")).alias("score"))
    top = scored.groupBy("id").agg(F.max("score").alias("top"))
    near = scored.join(top, "id").where(F.col("top") - F.col("score") <= within).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("name", "score").alias("name"), F.first("top").alias("score"))
    good = near.where((F.col("n") == 1) & (F.col("score") >= least)).select("id", "name", "score")
    return queries.join(good, "id", "left")


def engine_power(queries: DataFrame, powers: DataFrame) -> DataFrame:
    """(id, power) for queries (id, label, engine) among a label's powers (label, power).

    Powers that name the query's kW, if any do, are the only candidates; one alone is taken as it
    is, else the best overlap of at least 0.34, unless another is within 0.03.
    """
    kw = F.regexp_extract(F.coalesce("engine", F.lit("")), r"(?i)(\d{2,3})\s*k\s*w", 1)
    met = queries.withColumn("kw", kw).join(powers, "label").withColumn("et", overlap_tokens(F.col("power")))
    met = met.withColumn("named", (F.col("kw") != "") & F.array_contains("et", F.col("kw"))).withColumn("score", T.jaccard(overlap_tokens(F.col("engine")), F.col("et")))
    w = Window.partitionBy("id")
    met = met.withColumn("any_named", F.max(F.col("named").cast("int")).over(w) == 1).where("named or not any_named")
    met = met.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("top", F.max("score").over(w))
    met = met.withColumn("close", F.count_if(F.col("top") - F.col("score") <= 0.03).over(w))
    alone = F.col("any_named") & (F.col("n") == 1)
    return met.where(alone | ((F.col("score") == F.col("top")) & (F.col("top") >= 0.34) & (F.col("close") == 1))).select("id", "power")


def first_resolved_context(contexts: DataFrame, entries: DataFrame, least: float = 0.28, within: float = 0.03) -> DataFrame:
    """(id, label) by the first of several texts (id, pos, text) that picks one label clearly."""
    keyed = contexts.withColumn("key", F.struct("id", "pos")).select(F.col("key").alias("id"), "text")
    found = best_unambiguous(keyed, entries, least, within).where("name is not null")
    return found.groupBy(F.col("id.id").alias("id")).agg(F.min_by("name", F.col("id.pos")).alias("label"))


def resolve_by_years(queries: DataFrame, entries: DataFrame, least: float = 0.15) -> DataFrame:
    """(id, label): among labels whose years hold the query's year, the one, or the best, of `least`.

    The score is word overlap, plus 0.35 where one name contains the other.
    """
    e = entries.select(F.col("name").alias("label"), B.label_base(F.col("name")).alias("base"), B.label_years(F.col("name")).alias("years")).where("years is not null")
    met = queries.join(e, F.col("year").between(F.col("years.start"), F.col("years.end")))
    a, b = B.comparable(F.col("text")), B.comparable(F.col("base"))
    bonus = F.when((a != "") & (F.contains(a, b) | F.contains(b, a)), 0.35).otherwise(0.0)
    met = met.withColumn("score", T.jaccard(overlap_tokens(F.col("text")), overlap_tokens(F.col("base"))) + bonus).where(F.col("score") >= least)
    return met.groupBy("id").agg(F.max_by("label", F.struct("score", F.reverse("label"))).alias("label"))


def resolve_vehicle(rows: DataFrame, families: DataFrame, aliases: DataFrame) -> DataFrame:
    """`rows` (id, brand, model) with brand and family by key, else through an alias."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    known = families.select(key(F.col("brand")).alias("bk"), key(F.col("family")).alias("fk"), F.col("brand").alias("known_brand"), F.col("family").alias("known_family")).dropDuplicates(["bk", "fk"])
    named = aliases.select(key(F.col("alias")).alias("ak"), key(F.col("brand")).alias("alias_bk")).dropDuplicates(["ak"])
    keyed = rows.withColumn("ak", key(F.col("brand"))).withColumn("fk", key(F.col("model"))).join(named, "ak", "left")
    keyed = keyed.withColumn("bk", F.coalesce("alias_bk", "ak"))
    return keyed.join(known, ["bk", "fk"], "left").select(*rows.columns, "known_brand", "known_family")


def longest_prefix(urls: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each (id, url) with the profile (match, profile) of the longest matching domain or prefix.

    Every prefix of host and path is looked up, an equi-join in place of a comparison of all pairs.
    """
    bare = F.regexp_replace(F.lower("url"), r"^https?://(www\.)?|[/?#]+$", "")
    ends = F.sequence(F.lit(1), F.length("bare"))
    cut = F.transform(F.filter(ends, lambda n: (n == F.length("bare")) | F.substring("bare", n + 1, F.lit(1)).isin("/", "?", "#")), lambda n: F.substring("bare", F.lit(1), n))
    host = F.split(F.split_part("bare", F.lit("/"), F.lit(1)), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(host)), lambda n: F.array_join(F.slice(host, n, F.size(host)), "."))
    asked = urls.where("url <> ''").withColumn("bare", bare).where("bare <> ''").select("id", F.explode(F.array_union(cut, parents)).alias("match"))
    keyed = profiles.withColumn("match", F.regexp_replace(F.lower("match"), r"^https?://(www\.)?|/+$", ""))
    best = asked.join(keyed, "match").groupBy("id").agg(F.max_by("profile", F.length("match")).alias("profile"))
    return urls.join(best, "id", "left")


def merge_extra(catalog: DataFrame, extra: DataFrame) -> DataFrame:
    """`catalog` (market, brand, models) with the models of `extra` appended to brands it has."""
    more = extra.groupBy("market", "brand").agg(F.flatten(F.collect_list("models")).alias("__more"))
    joined = catalog.join(more, ["market", "brand"], "left")
    return joined.withColumn("models", F.when(F.col("__more").isNull(), F.col("models")).otherwise(F.concat("models", "__more"))).drop("__more")


def generation_options(index: DataFrame, family: Column) -> DataFrame:
    """Distinct labels per (brand, family), for rows whose generation is unknown."""
    return index.groupBy("brand", family.alias("family")).agg(F.array_sort(F.collect_set("label")).alias("generations"))
