"""Known-fault statistics and dictionary lookup, for any number of vehicles or codes in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import vehicles as V

MOST_CASES = 25


def with_model(cases: DataFrame) -> DataFrame:
    """`cases` with model_base, model_gen and model_year, to be stored at ingest."""
    label = F.col("vehicle_model")
    return cases.withColumns({"model_base": M.model_family(label), "model_gen": M.model_generation(label), "model_year": M.model_year(label)})


def origin(source_ref: Column, id: Column) -> Column:
    """What counts as one source: its reference, else the row itself."""
    return F.coalesce(F.nullif(source_ref, F.lit("")), id.cast("string"))


def matched(cases: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Approved cases of each vehicle (query_id, brand, model) with band, gen_match and origin."""
    label = F.col("model")
    asked = vehicles.select("query_id", F.col("brand").alias("__brand"), M.model_family(label).alias("__fam"), M.model_generation(label).alias("__gen"), M.model_year(label).alias("__yr"))
    rows = cases.where("status = 'approved'").join(asked, (F.col("vehicle_brand") == F.col("__brand")) & (F.col("model_base") == F.col("__fam")))
    match = M.generation_match(F.col("__gen"), F.col("__yr"), F.col("model_gen"), F.col("vehicle_generation"), F.col("model_year"))
    return rows.withColumns({"band": M.mileage_band(F.col("mileage")), "gen_match": match, "origin": origin(F.col("source_ref"), F.col("id"))}).drop("__brand", "__fam", "__gen", "__yr")


def known_faults(cases: DataFrame, taxonomy: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Sources per fault, band and generation match; a source in two bands counts in both."""
    counts = matched(cases, vehicles).groupBy("query_id", F.col("canonical_fault_id").alias("fault_id"), "band", "gen_match").agg(F.countDistinct("origin").alias("cnt"))
    labels = taxonomy.select(F.col("id").alias("fault_id"), "label_cs", "label_en", "label_de", "category")
    return counts.join(labels, "fault_id", "left").select("query_id", "fault_id", "label_cs", "label_en", "label_de", "category", "band", "gen_match", "cnt")


def fault_panel(counts: DataFrame, matches: tuple[str, ...] = ("exact",)) -> DataFrame:
    """One row per classified fault with its counts per band and over all, most frequent first."""
    kept = counts.where(F.col("gen_match").isin(*matches) & F.col("fault_id").isNotNull() & (F.col("fault_id") != "other") & (F.col("fault_id") != ""))
    per = kept.groupBy("query_id", "fault_id").pivot("band", list(M.BANDS)).agg(F.sum("cnt"))
    named = kept.groupBy("query_id", "fault_id").agg(*(F.coalesce(F.max(c), F.first("fault_id")).alias(c) for c in ("label_cs", "label_en", "label_de")), F.coalesce(F.max("category"), F.lit("other")).alias("category"), F.sum("cnt").alias("all"))
    zeros = [F.coalesce(F.col(f"`{b}`"), F.lit(0)).alias(b) for b in M.BANDS]
    return named.join(per.select("query_id", "fault_id", *zeros), ["query_id", "fault_id"]).orderBy("query_id", F.desc("all"), "fault_id")


def panel_totals(counts: DataFrame, matches: tuple[str, ...] = ("exact",)) -> DataFrame:
    """total, unclassified and gen_unknown of each vehicle."""
    open_fault = F.col("fault_id").isNull() | F.col("fault_id").isin("other", "")
    chosen = F.col("gen_match").isin(*matches)
    sums = {"total": chosen, "unclassified": chosen & open_fault, "gen_unknown": F.col("gen_match") == "unknown"}
    return counts.groupBy("query_id").agg(*(F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0)).alias(n) for n, c in sums.items()))


def band_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("query_id").agg(*(F.sum(F.col(f"`{b}`")).alias(b) for b in ("all", *M.BANDS)))


def known_fault_cases(cases: DataFrame, vehicles: DataFrame, limit: int | None = 10) -> DataFrame:
    """Newest case of each source for (query_id, brand, model, fault_id, band, gen), newest first.

    A null band takes every band, a gen other than 'exact' every generation.
    """
    n = min(max(10 if limit is None else limit, 1), MOST_CASES)
    wanted = vehicles.select("query_id", F.col("fault_id").alias("__fault"), F.col("band").alias("__band"), F.coalesce("gen", F.lit("exact")).alias("__gen"))
    rows = matched(cases, vehicles).join(wanted, "query_id").where((F.col("canonical_fault_id") == F.col("__fault")) & (F.col("__band").isNull() | (F.col("band") == F.col("__band"))) & ((F.col("__gen") != "exact") | (F.col("gen_match") == "exact")))
    newest = [F.col("closed_at").desc_nulls_last(), F.col("id")]
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "origin").orderBy(*newest))).where("__n = 1")
    top = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*newest))).where(F.col("rank") <= n)
    return top.drop("__n", "__fault", "__band", "__gen")


def lookup_codes(dictionary: DataFrame, asked: DataFrame) -> DataFrame:
    """One entry per asked (code, brand_group): the brand group's own before the generic one."""
    a = asked.select(F.upper("code").alias("__code"), F.col("brand_group").alias("__group")).distinct()
    met = a.join(dictionary, (F.upper(dictionary["code"]) == F.col("__code")) & (dictionary["brand_group"].isNull() | (dictionary["brand_group"] == F.col("__group"))))
    own_first = Window.partitionBy("__code", "__group").orderBy(F.col("brand_group").isNull(), "brand_group")
    return met.withColumn("__n", F.row_number().over(own_first)).where("__n = 1").drop("__n").withColumnsRenamed({"__code": "asked_code", "__group": "asked_group"})


def top_codes(cases: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n most frequent codes of each `key`; ties by code."""
    codes = cases.select(key, F.explode("obd_codes").alias("code")).select(key, F.upper(F.trim("code")).alias("code")).where("code <> ''")
    counts = codes.groupBy(key, "code").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def codes_of_cars(cars: DataFrame, lists: DataFrame) -> DataFrame:
    """`cars` (id, brand, tags) with sorted arrays `common`, `engine` and `brand_codes` of trouble codes.

    `lists` (level, name, code) holds common codes, those of an engine's technology, and those of a
    maker.  It is reduced to one row per name first, so nothing grows with the cars; codes that are
    common are left out of the engine's.  Brands and tags without a list get empty arrays.
    """
    none = F.array().cast("array<string>")
    per = lists.groupBy("level", "name").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    common = per.where("level = 'common'").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("common"))
    engine = per.where("level = 'engine'").agg(F.map_from_entries(F.collect_list(F.struct("name", "codes"))).alias("__engine"))
    maker = per.where("level = 'brand'").select(F.col("name").alias("__maker"), F.col("codes").alias("__own"))
    row = common.crossJoin(F.broadcast(engine))  # one row each: an aggregate without keys
    met = cars.crossJoin(F.broadcast(row)).join(maker, V.codes_brand(F.col("brand")) == F.col("__maker"), "left")
    tags = F.flatten(F.transform("tags", lambda t: F.coalesce(F.element_at("__engine", t), none)))
    extra = F.array_sort(F.array_except(tags, F.coalesce("common", none)))
    return met.withColumn("engine", extra).withColumn("brand_codes", F.coalesce("__own", none)).drop("__engine", "__maker", "__own")
