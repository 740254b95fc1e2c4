"""Rule-based quality gates: the first failing rule is the reason, or every rule that fails is an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bulletin_text as X
from ..functions import bulletins as B
from ..functions import text as T
from ..functions.scoring import bulletin_prose, clean

#: Wording of repairs that are announced, not done.
UNRESOLVED = (
    r"\bnap[ií][sš]u\b.{0,50}\b(?:jak|az|až)\b.{0,40}\bdopadlo\b",
    r"\b(?:z[ií]tra|tomorrow)\b.{0,60}\b(?:bude|by mělo být|should be|will be)\b.{0,20}\bok\b",
    r"\b(?:dnes|today)\b.{0,60}\b(?:odvezl|odvezla|took it in|taken in)\b.{0,80}\b(?:opravu|repair)\b",
    r"\b(?:pl[aá]nuj(?:i|e)|planning to|plan to)\b.{0,80}\b(?:servis|service|electrician|repair|opravu)\b",
    r"\b(?:will|nap[ií][sš]u)\b.{0,40}\b(?:update|let you know|report back)\b",
)


def filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def first_of(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F
    for holds, name in rules:
        out = out.when(holds, name)
    return out.otherwise(None)


def issues(**rules: Column) -> Column:
    """The names of all rules that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


def unresolved(resolution: Column) -> Column:
    return B.any_of(resolution, UNRESOLVED)


def validated(cases: DataFrame) -> DataFrame:
    """`cases` with reason (null if valid) and warnings.

    Uses vehicle_brand, vehicle_model, symptoms, description, resolution, obd_codes, mileage,
    engine_power, and, where they exist, author_reason and bleed_reason of `checked_posts`.
    """
    texts = F.size(F.filter(F.coalesce("symptoms", F.array().cast("array<string>")), filled)) > 0
    complete = filled(F.col("vehicle_brand")) & filled(F.col("vehicle_model")) & texts & filled(F.col("description")) & filled(F.col("resolution"))
    short = lambda c: F.length(F.trim(c)) < 15
    rules = [(~complete, "incomplete"), (unresolved(F.col("resolution")), "unresolved"), (short("resolution"), "short_resolution"), (short("description"), "short_description")]
    later = [F.col(c) for c in ("author_reason", "bleed_reason") if c in cases.columns]
    reason = F.coalesce(first_of(*rules), *later) if later else first_of(*rules)
    warnings = issues(no_codes=F.coalesce(F.size("obd_codes"), F.lit(0)) <= 0, no_mileage=F.coalesce("mileage", F.lit(0)) == 0, no_engine=~filled(F.col("engine_power")))
    return cases.withColumn("reason", reason).withColumn("warnings", F.when(F.col("reason").isNull(), warnings))


def checked_posts(cases: DataFrame, posts: DataFrame) -> DataFrame:
    """`cases` (id, thread_id, case_author, vehicle_model, fault_posts, fix_posts, title) with author_reason and bleed_reason.

    `posts`: thread_id, number, author, body.  Cited posts must exist; fault posts must be by the
    case's author; the model must not stand only in another's fix post.  Post numbers meet posts by
    an equi-join.
    """
    name = lambda c: T.fold_words(F.coalesce(c, F.lit("")))
    p = posts.select("thread_id", "number", name(F.col("author")).alias("by"), F.split(name(F.col("body")), " ").alias("words"))
    base = cases.select("id", "thread_id", name(F.col("case_author")).alias("me"), F.filter(F.split(name(F.col("vehicle_model")), " "), lambda t: F.length(t) >= 2).alias("model"), F.split(name(F.col("title")), " ").alias("title"), "fault_posts", "fix_posts")
    met = base.join(p, "thread_id", "left")
    fault, fix = F.array_contains("fault_posts", F.col("number")), F.array_contains("fix_posts", F.col("number"))
    mine = F.coalesce(fault, F.lit(False)) | ((F.col("me") != "") & (F.col("by") == F.col("me")))
    named = F.arrays_overlap("model", "words")
    per = met.groupBy("id").agg(
        F.count("number").alias("n"),
        F.count_if(fault).alias("faults"),
        F.count_if(fix).alias("fixes"),
        F.count_if(fault & (F.col("by") != "") & (F.col("by") != F.col("me"))).alias("foreign"),
        F.coalesce(F.bool_or(mine & named), F.lit(False)).alias("own"),
        F.coalesce(F.bool_or(fix & (F.col("me") != "") & (F.col("by") != F.col("me")) & named), F.lit(False)).alias("other"),
    )
    rows = base.join(per, "id")
    wanted = lambda c: F.size(F.array_distinct(F.coalesce(c, F.array().cast("array<int>"))))
    author = first_of(
        (F.col("n") == 0, None),
        (wanted("fault_posts") == 0, "no_fault_posts"),
        (wanted("fix_posts") == 0, "no_fix_posts"),
        (F.col("me") == "", "no_author"),
        (F.col("faults") < wanted("fault_posts"), "fault_post_missing"),
        (F.col("foreign") > 0, "fault_post_author"),
        (F.col("fixes") < wanted("fix_posts"), "fix_post_missing"),
    )
    in_title = F.arrays_overlap("model", "title")
    bleed = F.when((F.size("model") > 0) & ~F.coalesce(in_title, F.lit(False)) & ~F.col("own") & F.col("other"), "wrong_vehicle")
    return cases.join(rows.select("id", author.alias("author_reason"), bleed.alias("bleed_reason")), "id", "left")


def classifier_approved(row: dict[str, Column], evidence: Column) -> Column:
    """Strictly true flags and, as evidence, the number of at least one post: a whole number above 0."""
    number = lambda n: F.coalesce((n > 0) & (n.cast("double") == F.floor(n.cast("double"))), F.lit(False))
    out = F.coalesce(F.exists(evidence, number), F.lit(False))
    for c in row.values():
        out = out & F.coalesce(c, F.lit(False))
    return out


def quoted_promotions(queue: DataFrame, cases: DataFrame, threads: DataFrame, quotes: DataFrame, least_thread: int = 200) -> DataFrame:
    """Open queue rows of clause d whose quote stands word for word in a thread long enough."""
    open_rows = queue.where("resolved_at is null and clause = 'd'").select(F.col("case_local_id").alias("local_id"))
    pending = cases.where("status = 'pending'").select("local_id", "thread_url")
    text = threads.select(F.col("url").alias("thread_url"), "thread_text").where(F.length("thread_text") >= least_thread)
    met = open_rows.join(pending, "local_id").join(text, "thread_url").join(quotes.select("local_id", "quotes"), "local_id")
    found = T.verified_quotes(F.col("quotes"), F.col("thread_text"))
    return met.where(F.size(found) > 0).select("local_id", found.alias("quotes"))


#: Patterns of bulletin records, by what they decide.
CODES = (r"\bp[0-9a-f]{4}\b", r"\bc[0-9a-f]{4}\b", r"\bu[0-9a-f]{4}\b", r"\bb[0-9a-f]{4}\b")
ACTION = (r"\breplac(?:e|ed|ement|ing)\b", r"\bupdate(?:d)?\b", r"\breprogram(?:med|ming)?\b", r"\breflash(?:ed)?\b", r"\binspect(?:ion|ed)?\b", r"\bclean(?:ed|ing)?\b", r"\btighten(?:ed|ing)?\b", r"\badjust(?:ed|ment)?\b", r"\brepair(?:ed)?\b", r"\binstall(?:ed|ation)?\b", r"\btorque(?:d)?\b", r"\bcalibrat(?:e|ed|ion)\b", r"\breseal(?:ed)?\b", r"\bbleed(?: the)?\b")
SYMPTOM = (
    r"\bnon-responsive\b", r"\binoperative\b", r"\bwarning light\b", r"\bmalfunction\b", r"\bconcern\b", r"\bissue\b", r"\bproblem\b", r"\bno start\b", r"\bwon['’]?t start\b", r"\bstall(?:ing|ed)?\b", r"\bhesitat(?:e|ion)\b", r"\bjerk(?:ing)?\b", r"\bmisfire\b", r"\boverheat(?:ing)?\b", r"\bleak(?:ing)?\b",
    r"\bnoise\b", r"\bvibration\b", r"\bdrain\b", r"\bdischarg(?:e|ing)\b", r"\bnot respond\b", r"\bdoes not respond\b", r"\bnot charging\b", r"\bwon['’]?t charge\b", r"\bshut(?:s)? off\b", r"\bfault\b", r"\bdtc\b", *CODES,
)
CONCRETE = (
    r"\bnon-responsive\b", r"\binoperative\b", r"\bwarning light\b", r"\bmalfunction indicator lamp\b", r"\bmil illumination\b", r"\bwon['’]?t start\b", r"\bno start\b", r"\bstall(?:ing|ed)?\b", r"\bhesitat(?:e|ion)\b", r"\bjerk(?:ing)?\b", r"\bmisfire\b", r"\boverheat(?:ing)?\b", r"\bleak(?:ing)?\b", r"\bnoise\b",
    r"\bvibration\b", r"\bdrain\b", r"\bdischarg(?:e|ing)\b", r"\bnot charging\b", r"\bwon['’]?t charge\b", r"\bshut(?:s)? off\b", r"\bvehicle enters? into limp home mode\b", r"\bturtle icon\b", r"\bwrench icon\b", r"\bmay experience\b", r"\bcustomers may also comment\b", r"\bcustomers must experience\b", r"\bdtc\b", *CODES,
)
NOTICE = (
    r"\bowner renotification\b", r"\bowner notification\b", r"\bowner letter\b", r"\bcustomer satisfaction\b", r"\bwarranty extension(?!.*(?:warning|fault|concern|issue|problem|repair|replace|reprogram|update))", r"\bdealer message\b", r"\bservice campaign\b", r"\bparts return\b", r"\bclaim submission\b", r"\bshipping\b", r"\bpolicy\b",
)
GROUP_MAKES = ("CHEVROLET", "GMC", "CADILLAC", "BUICK")
GROUP_NOTICE = (
    r"\b(?:submit|send|upload)\b[\s\S]{0,120}\b(?:gds|snapshot|session logs?|diagnostic data|data log|log file|pictures?|photos?)\b[\s\S]{0,120}\b(?:tac|technical assistance center)\b", r"\bprovide a pico file to receive diagnostic assistance from tac\b", r"\bemail gds2 session logs into technical assistance\b", r"\b(?:contact|call)\s+tac\b", r"\buse the following labor code\b",
    r"\blabor code\b[\s\S]{0,80}\b(?:warranty|claim|transaction)\b", r"\bproper floor mat use\b", r"\bfloor mat\b[\s\S]{0,80}\b(?:retention|usage|interference)\b", r"\bunderbody component corrosion\b", r"\bfluid testing procedures?\b", r"\bhow to recover the image processing module\b", r"\buse of j-35616-64b\b",
    r"\bmultiple repair attempts\b[\s\S]{0,220}\btechnical assistance center\b", r"\btire sidewall irregularities\b", r"\bnormal transmission shift condition\b", r"\bbefore being sold\b[\s\S]{0,80}\bfull inspection\b", r"\bvehicle stock on hand\b[\s\S]{0,120}\bprepping\b", r"\bdiagnose batteries that have set for a long period of time\b",
    r"\bcold weather climates and testing those batteries\b", r"\bwhen the engine is replaced after severe internal engine damage\b", r"\bparts catalog assistance\b", r"\btool usage\b", r"\bdo not replace any parts at this time\b",
)
VAGUE_FIX = (
    r"^follow the service procedure\b", r"^follow the bulletin(?: repair)? procedure\b", r"^refer to\b", r"^see bulletin\b", r"^perform service action\b", r"^this (?:service|technical) bulletin provides repair information\b", r"^this (?:service|technical) bulletin provides a repair procedure\b", r"^this preliminary information communicates\b",
    r"^this bulletin announces the availability of new reprogramming files\b",
)
PREVENTIVE = (r"\bprevent\b[\s\S]{0,160}\bunnecessarily\b", r"\bfalse\b[\s\S]{0,120}\b(?:do not replace|not to replace)\b", r"\bdo not replace the module\b", r"\bengineering is currently investigating\b", r"\bif no issue is found[\s\S]{0,120}\bdo not replace\b")
ACTION_FIRST = (r"^(?:update|upgrade|replace|reprogram|repair|inspect|clean|tighten|adjust|install|flash)\b",)
ANNOUNCED = (r"^[\"“”']?this bulletin announces availability",)
SERVICE, WARRANTY = "service bulletin/repair instructions", "warranty program/extension"


def bulletin_stage(kind: Column, make: Column, summary: Column, description: Column, resolution: Column, symptoms: Column, codes: Column) -> Column:
    """struct<stage, reason> of a bulletin record and what was extracted from it: an ordered list of decisions."""
    none = F.array().cast("array<string>")
    plain = F.lower(clean(kind))
    whole = clean(F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(summary, F.lit(""))))
    about, fix = clean(description), clean(resolution)
    symptoms, coded = F.coalesce(symptoms, none), F.coalesce(F.size(codes), F.lit(0)) > 0
    acts, shows = B.any_of(whole, ACTION), B.any_of(whole, SYMPTOM) | coded
    weak = (F.length(fix) < 10) | B.any_of(fix, VAGUE_FIX) | bulletin_prose(fix) | B.any_of(fix, ANNOUNCED) | ~B.any_of(fix, ACTION)
    steps = (
        (~plain.isin(SERVICE, WARRANTY), "discarded", "communication_type"),
        (B.any_of(whole, NOTICE), "discarded", "notice"),
        (F.upper(clean(make)).isin(*GROUP_MAKES) & B.any_of(whole, GROUP_NOTICE), "discarded", "administrative"),
        (~acts & ~shows, "discarded", "no_symptom_no_action"),
        (F.length(about) < 12, "to_review", "thin_description"),
        (B.any_of(whole, PREVENTIVE), "to_review", "preventive"),
        (B.any_of(about, ACTION_FIRST) | (F.lower(about) == F.lower(fix)), "to_review", "not_separated"),
        (bulletin_prose(about) | F.exists(symptoms, bulletin_prose), "to_review", "prose"),
        (weak, "to_review", "weak_resolution"),
        (F.size(symptoms) == 0, "to_review", "no_symptom"),
        (~(B.any_of(whole, CONCRETE) | coded), "to_review", "not_concrete"),
        ((plain == SERVICE) & acts & shows, "ready", "complete"),
    )
    out = F
    for holds, stage, reason in steps:
        out = out.when(holds, F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit("to_review").alias("stage"), F.lit("not_strong").alias("reason")))


def either(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def classified_bulletins(records: DataFrame) -> DataFrame:
    """`records` (kind, make, summary) with what their summaries say, `stage` and `reason`; clashing columns are replaced."""
    said = records.withColumn("__part", X.seed_parts(F.col("summary"), either(SYMPTOM), either(ACTION), either(ACTION_FIRST)))
    part = {c: F.col(f"__part.{c}") for c in ("description", "resolution", "symptoms", "obd_codes")}
    stage = bulletin_stage(F.col("kind"), F.col("make"), F.col("summary"), *part.values())
    return said.withColumn("__stage", stage).withColumns({**part, "stage": F.col("__stage.stage"), "reason": F.col("__stage.reason")}).drop("__part", "__stage")


def final_stage(stage: Column, resolved: Column) -> Column:
    """A ready record without a catalog entry goes back to review."""
    return F.when((stage == "ready") & ~F.coalesce(resolved, F.lit(False)), "to_review").otherwise(stage)


def kept_once(rows: DataFrame, known: DataFrame, id: str, order: str) -> DataFrame:
    """Answer rows whose id is known, each id once, the first in `order`."""
    met = rows.join(known.select(id).distinct(), id, "left_semi")
    return met.groupBy(id).agg(F.min_by(F.struct(*[c for c in rows.columns if c != id]), order).alias("r")).select(id, "r.*")
