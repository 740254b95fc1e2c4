"""Manual lookup over vertex and edge tables: hops are equi-joins, tiers are ranks.

Vertices: `sections` (id, title, repair_group, pdf_page, manual), `subsections` (id, section, number,
title), `components` (subsection, name), `vehicles` (manual, model), `engines` (manual, displacement,
fuel_type).  Edges are the foreign keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clean

MOST = 15


def _has(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def vehicle_matches(vehicles: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, manual) where the model's name contains the asked one or is contained in it."""
    names = vehicles.select("manual", "model").distinct()
    a = asked.where("model is not null and model <> ''").select("query_id", F.col("model").alias("asked"))
    return a.join(names, _has(F.col("model"), F.col("asked")) | _has(F.col("asked"), F.col("model"))).select("query_id", "manual").distinct()


def component_sections(sections: DataFrame, subsections: DataFrame, components: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, section) with the components found and how many sub-sections name them."""
    # containment is tested on distinct names, of which there are few; components follow by an equi-join
    names = terms.join(components.select("name").distinct(), _has(F.col("name"), F.col("term"))).select("query_id", "name").distinct()
    hits = names.join(components.select("subsection", "name"), "name")
    return hits.join(subsections.select(F.col("id").alias("subsection"), "section"), "subsection").groupBy("query_id", "section").agg(F.countDistinct("subsection").alias("sub_count"), F.array_sort(F.collect_set("name")).alias("found"))


def lookup(sections: DataFrame, subsections: DataFrame, components: DataFrame, vehicles: DataFrame, asked: DataFrame, most: int = MOST) -> DataFrame:
    """Sections for each asked (query_id, term, model, repair_group), relaxed tier by tier.

    Tier 1 wants component and vehicle, 2 the component, 3 words of the title, 4 the repair group;
    the first tier with any hit answers, its sections by hinted group, title hit, and sub-sections.
    """
    own = vehicle_matches(vehicles, asked)
    terms = asked.where("term is not null and term <> ''").select("query_id", "term")
    by_part = component_sections(sections, subsections, components, terms)
    rows = sections.withColumnRenamed("id", "section")
    part = by_part.join(rows, "section")
    tier1 = part.join(own, ["query_id", "manual"], "left_semi").withColumn("tier", F.lit(1))
    tier2 = part.withColumn("tier", F.lit(2))
    none = {"sub_count": F.lit(0).cast("long"), "found": F.array().cast("array<string>")}
    words = terms.select("query_id", F.explode(F.filter(F.split(F.lower(clean(F.col("term"))), " "), lambda w: F.length(w) > 2)).alias("word")).distinct()
    titles = rows.withColumn("word", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("title"), r"[^\p{L}0-9]+", " "), " "))))
    tier3 = titles.join(words, "word").drop("word").dropDuplicates(["query_id", "section"]).withColumns(none).withColumn("tier", F.lit(3))
    group = asked.where("repair_group is not null").select("query_id", "repair_group").distinct()
    tier4 = rows.join(group, "repair_group").withColumns(none).withColumn("tier", F.lit(4))
    columns = ["query_id", "tier", "section", "title", "repair_group", "pdf_page", "manual", "sub_count", "found"]
    everything = tier1.select(*columns)
    for t in (tier2, tier3, tier4):
        everything = everything.unionByName(t.select(*columns))
    best = everything.groupBy("query_id").agg(F.min("tier").alias("tier"))
    hint = asked.select("query_id", F.col("repair_group").alias("hint"), "term").dropDuplicates(["query_id"])
    met = everything.join(best, ["query_id", "tier"]).join(hint, "query_id")
    order = [(F.coalesce(F.col("repair_group") == F.col("hint"), F.lit(False))).desc(), F.coalesce(_has(F.col("title"), F.col("term")), F.lit(False)).desc(), F.desc("sub_count"), "repair_group", "section"]
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("query_id", "tier", "rank", *columns[2:])


def token_search(sections: DataFrame, text: DataFrame, asked: DataFrame, least: float = 0.3, most: int = 20) -> DataFrame:
    """Sections by share of the asked words in title and content; stands in for a search index's score."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}0-9]+", " "), " "), lambda w: F.length(w) > 2))
    docs = text.select("section", F.explode(words(F.concat_ws(" ", "title", "content"))).alias("word"))
    q = asked.select("query_id", words(F.col("term")).alias("ws")).withColumn("n", F.size("ws")).where("n > 0").select("query_id", "n", F.explode("ws").alias("word"))
    hits = q.join(docs, "word").groupBy("query_id", "section", "n").agg(F.count(F.lit(1)).alias("hits"))
    scored = hits.select("query_id", "section", (F.col("hits") / F.col("n")).alias("score")).where(F.col("score") > least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "section"))).where(F.col("rank") <= most)


def browse_group(sections: DataFrame, subsections: DataFrame, group: str) -> DataFrame:
    """Sections of a repair group with their sub-sections, also those without any."""
    subs = subsections.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("number", "title"))).alias("subsections"))
    return sections.where(F.col("repair_group") == group).join(subs, F.col("id") == F.col("section"), "left").select("id", "title", "pdf_page", F.coalesce("subsections", F.array().cast(subs.schema["subsections"].dataType)).alias("subsections")).orderBy("pdf_page", "id")


def list_vehicles(vehicles: DataFrame, engines: DataFrame, most: int = 30) -> DataFrame:
    e = engines.groupBy("manual").agg(F.array_sort(F.collect_set(F.concat_ws(" ", F.col("displacement").cast("string"), "fuel_type"))).alias("engines"))
    return vehicles.join(e, "manual", "left").groupBy("model").agg(F.array_sort(F.collect_set("manual")).alias("manuals"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("engines", F.array().cast("array<string>")))))).alias("engines")).orderBy("model").limit(most)
