"""Deduplication with survivorship.

Winners are single rows picked by a struct of ordering keys: `max_by`/`min_by` aggregates merge on the
map side, so a key with very many rows never meets in one task before it is a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bulletins as B
from ..functions import text as T
from ..functions.scoring import clean

#: Which status of a case, and of a thread, outweighs which.
CASE_STATUS = {"imported": 90, "import_ready": 80, "verified": 70, "ai_approved": 60, "crosscheck_error": 50, "import_failed": 40, "verify_error": 30, "verify_skipped": 20, "verify_rejected": 10, "crosscheck_dupe": 5, "quarantined": 4}
THREAD_STATUS = {"extracted": 50, "deferred": 40, "pending": 30, "error": 20, "discarded": 10}

ROWS_A_TASK = 250_000  # of threads, that a task sorts


def priority(status: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), status), F.lit(0))


def length(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def survivors(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`, which must be total.  Partial aggregation first."""
    key = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    packed = rows.select(*key, F.struct(*rows.columns).alias("__row"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("__order"))
    return packed.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def split_dropped(rows: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by a ranking within the keys; for groups that are known to be small."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")


def collapse_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds that say the same become one: the higher revision, then the newer year, then the first.

    Lists of variants are united; the winner's count becomes the number of rows it stands for.
    `seeds`: seq, stage, vehicle_brand, vehicle_model, obd_codes, description, resolution,
    source_ref, model_year, source_refs, model_years.
    """
    key = [F.lower(clean(F.col(c))).alias(f"__{c}") for c in ("stage", "vehicle_brand", "vehicle_model", "description", "resolution")]
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("obd_codes", F.array().cast("array<string>")), F.upper))), ",").alias("__codes")
    keyed = seeds.select("*", *key, codes)
    names = ["__stage", "__vehicle_brand", "__vehicle_model", "__description", "__resolution", "__codes"]
    rank = F.struct(B.revision_rank(F.col("source_ref")).alias("r"), F.coalesce(F.col("model_year").try_cast("int"), F.lit(0)).alias("y"), (-F.col("seq")).alias("s"))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    own = [c for c in seeds.columns if c not in ("source_refs", "model_years")]
    out = keyed.groupBy(*names).agg(F.max_by(F.struct(*own), rank).alias("w"), united("source_refs").alias("source_refs"), united("model_years").alias("model_years"), F.count(F.lit(1)).alias("source_variant_count"))
    return out.select("w.*", "source_refs", "model_years", "source_variant_count")


def superseded(cases: DataFrame) -> DataFrame:
    """Cases with one model and resolution whose bulletin has a newer revision, with the keeper."""
    group = ["__model", "__resolution", "__base"]
    keyed = cases.select("id", "source_ref", "created_at", F.lower(F.coalesce("vehicle_model", F.lit(""))).alias("__model"), F.lower(F.coalesce("resolution", F.lit(""))).alias("__resolution"), B.base_bulletin(F.col("source_ref")).alias("__base"), B.agency_number(F.col("source_ref")).alias("__number"))
    order = F.struct((-F.col("__number")).alias("n"), F.col("created_at").alias("c"), F.col("id").alias("i"))
    keepers = keyed.groupBy(*group).agg(F.min_by(F.struct("id", "source_ref", F.col("__number").alias("number")), order).alias("keeper"))
    met = keyed.join(keepers, group).where(F.col("id") != F.col("keeper.id"))
    reason = F.when(F.col("source_ref").eqNullSafe(F.col("keeper.source_ref")), "exact duplicate").when(F.col("keeper.number") > F.col("__number"), "older revision").otherwise("same bulletin")
    return met.select("id", F.col("keeper.id").alias("kept_id"), reason.alias("reason"))


def repair_threads(threads: DataFrame, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """(threads by canonical address with merged texts, old id to surviving id)."""
    rows = threads.withColumn("__url", canonical)
    first = F.struct((-priority(F.col("status"), THREAD_STATUS)).alias("a"), (-length(F.col("thread_text"))).alias("b"), (-length(F.col("title"))).alias("c"), (F.col("url") != F.col("__url")).alias("d"), F.col("created_at").alias("e"), F.col("id").alias("f"))
    early = F.struct("created_at", "id")
    longest = lambda c: F.max_by(F.nullif(F.col(c), F.lit("")), F.struct(length(F.col(c)).alias("n"), F.col("id").alias("i")))
    reason = F.min_by("discard_reason", F.when(F.coalesce("discard_reason", F.lit("")) != "", early))
    kept = rows.groupBy("__url").agg(F.min_by(F.struct("id", "forum_id", "status", "created_at"), first).alias("p"), longest("title").alias("title"), longest("thread_text").alias("thread_text"), reason.alias("discard_reason"))
    kept = kept.select("p.id", "p.forum_id", F.col("__url").alias("url"), "title", "p.status", "discard_reason", "thread_text", "p.created_at")
    moved = rows.select(F.col("id").alias("old_id"), "__url").join(kept.select(F.col("id").alias("new_id"), F.col("url").alias("__url")), "__url").where("old_id <> new_id").select("old_id", "new_id")
    return kept, moved


def repair_cases(cases: DataFrame) -> DataFrame:
    """One case per (thread_url, case_author), cases without either as they are."""
    author = F.lower(F.trim(F.coalesce("case_author", F.lit(""))))
    rows = cases.withColumn("__author", author)
    keyed = (F.coalesce("thread_url", F.lit("")) != "") & (F.col("__author") != "")
    order = [-priority(F.col("status"), CASE_STATUS), -length(F.col("review_note")), F.col("created_at"), F.col("id")]
    return survivors(rows.where(keyed), ["thread_url", "__author"], order).unionByName(rows.where(~keyed)).drop("__author")


def richness(symptoms: Column, description: Column, resolution: Column, fault_posts: Column, fix_posts: Column) -> Column:
    posts = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return F.struct((posts(fault_posts) + posts(fix_posts)).alias("posts"), length(resolution).alias("resolution"), length(description).alias("description"), posts(symptoms).alias("symptoms"))


def tasks_for(rows: int, least: int) -> int:
    """How many tasks hold `rows` rows of threads, at most ROWS_A_TASK each on average."""
    return max(least, -(-rows // ROWS_A_TASK))


def by_thread(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt by thread: what follows within threads needs no other exchange, and a task's memory goes with its rows."""
    return rows.repartition(tasks, "thread_id")


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(thread_id, idx, cluster) from judged clusters (thread_id, size, clusters: array<array<int>>).

    Places out of range go, a place belongs to the first cluster that names it, clusters of one go.
    """
    flat = clusters.where("thread_id is not null").select("thread_id", "size", F.posexplode("clusters").alias("cluster", "idxs")).select("thread_id", "size", "cluster", F.explode("idxs").alias("idx")).where("idx >= 0 and idx < size")
    first = flat.groupBy("thread_id", "idx").agg(F.min("cluster").alias("cluster"))
    counted = first.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("thread_id", "cluster")))
    return counted.where("__n >= 2").drop("__n")


def keep_richest(cases: DataFrame, members: DataFrame) -> DataFrame:
    """Cases (thread_id, idx, richness, ...) less those that a richer member of their cluster covers.

    Large tables are dealt with `by_thread` before, both alike.  They meet by thread alone, a thread's members as a map:
    a join by place as well would deal both again.
    """
    of = members.groupBy("thread_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "cluster"))).alias("__of"))
    met = cases.join(of, "thread_id", "left").withColumn("cluster", F.try_element_at("__of", F.col("idx"))).drop("__of")
    best = F.max(F.struct("richness", (-F.col("idx")).alias("i"), "idx")).over(Window.partitionBy("thread_id", "cluster"))
    return met.withColumn("__best", best).where("cluster is null or idx = __best.idx").drop("cluster", "__best")


def against_known(candidates: DataFrame, known: DataFrame, newest: int = 200) -> DataFrame:
    """Each candidate with duplicate or clear: any of its brand's newest known cases is likely it.

    Brand names match by containment, either name being cut to its first word for the blocking key.
    What is compared, keys and tokens, is computed once per row, before rows meet.
    """
    plain = lambda c: F.lower(clean(c))
    word = lambda c: F.get(F.split(plain(c), " "), 0)

    def compared(rows: DataFrame, side: str, *more: Column) -> DataFrame:
        r = F.col("resolution")
        return rows.select(F.col("id").alias(f"{side}id"), plain(F.col("vehicle_brand")).alias(f"{side}b"), word(F.col("vehicle_brand")).alias("block"), *more, clean(F.col("thread_url")).alias(f"{side}_url"), clean(F.col("source_ref")).alias(f"{side}_ref"), T.dedupe_key(r).alias(f"{side}_key"), T.dedupe_tokens(r).alias(f"{side}_tokens"))

    a, b = compared(candidates, "c"), compared(known, "k", F.col("created_at"))
    recent = b.withColumn("__n", F.row_number().over(Window.partitionBy("kb").orderBy(F.desc_nulls_last("created_at"), "kid"))).where(F.col("__n") <= newest)
    same = lambda k: (F.col(f"c_{k}") != "") & (F.col(f"c_{k}") == F.col(f"k_{k}"))
    alike = T.overlap(F.col("c_tokens"), F.col("k_tokens"))
    pair = (same("key") & (F.col("c_key") != "")) | (alike >= 0.95) | ((same("url") | same("ref")) & (alike >= 0.45))
    named = F.contains("kb", F.col("cb"))
    met = a.join(recent, "block", "left").withColumn("hit", named & pair)
    return met.groupBy("cid").agg(F.when(F.coalesce(F.bool_or("hit"), F.lit(False)), "duplicate").otherwise("clear").alias("status"), F.count_if(named).alias("compared")).withColumnRenamed("cid", "id")


def local_duplicates(cases: DataFrame) -> DataFrame:
    """(id, other) of cases of one thread (id, thread_id, seq, case_author, resolution) and an earlier one
    that is likely the same: by one author, or with one normalized resolution.

    Two equi-joins to the earliest case with the author or the resolution, never all pairs of a thread.
    """
    author, key = F.lower(F.trim(F.coalesce("case_author", F.lit("")))), T.dedupe_key(F.col("resolution"))
    rows = cases.select("id", "thread_id", "seq", author.alias("author"), key.alias("key"))
    found = None
    for c in ("author", "key"):
        first = rows.where(F.col(c) != "").groupBy("thread_id", c).agg(F.min(F.struct("seq", F.col("id").alias("other"))).alias("f"))
        met = rows.join(first, ["thread_id", c]).where(F.col("f.other") != F.col("id")).select("id", "f.seq", "f.other")
        found = met if found is None else found.unionByName(met)
    return found.groupBy("id").agg(F.min(F.struct("seq", "other"))["other"].alias("other"))


def greedy_two_keys(rows: DataFrame, group: str, key: str, second: str, order: list[Column], most: int) -> DataFrame:
    """Up to `most` rows per group in order, each new in `key` and in `second` (null: always new).

    A row refused for one key doesn't claim the other, which no pair of rankings can say; the walk
    goes over a group's sorted rows, so callers bound the group first.
    """
    item = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(key).alias("k"), F.col(second).alias("s"), F.struct(*rows.columns).alias("row"))
    ranked = rows.groupBy(F.col(group).alias("__g")).agg(F.array_sort(F.collect_list(item)).alias("r"))
    kind = ranked.schema["r"].dataType.simpleString()

    def walk(taken: Column, x: Column) -> Column:
        seen = F.exists(taken, lambda t: t["k"].eqNullSafe(x["k"]) | F.coalesce(t["s"] == x["s"], F.lit(False)))
        return F.when((F.size(taken) >= most) | seen, taken).otherwise(F.concat(taken, F.array(x)))

    return ranked.select(F.explode(F.aggregate("r", F.array().cast(kind), walk)).alias("x")).select("x.row.*")


def apply_decisions(cases: DataFrame, decisions: DataFrame, allowed: tuple[str, ...] = ("approved", "pending")) -> tuple[DataFrame, DataFrame]:
    """(cases with decided status, backup of the rows changed); only `allowed` statuses change."""
    wanted = decisions.select("id", F.col("status").alias("__new")).dropDuplicates(["id"])
    met = cases.join(wanted, "id", "left")
    change = F.col("__new").isNotNull() & F.col("status").isin(*allowed)
    backup = met.where(change).select("id", F.col("status").alias("old_status"), F.col("__new").alias("new_status"))
    return met.withColumn("status", F.when(change, F.col("__new")).otherwise(F.col("status"))).select(*cases.columns), backup
