"""Gates of curation: verdicts of models, second looks at bulletins, and what is safe to import.

Each gate is an ordered list of rules, the first that holds decides; or a list of issues, all that hold are named.
Answers of models are read as VARIANT: a field counts only if it has the type that is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bulletin_text as X
from ..functions import bulletins as B
from ..functions import text as T
from ..functions.scoring import clean

# ---- answers of models

#: The conditions of a verdict, in order.
CONDITIONS = ("in_scope", "vehicle_matches_cited_posts", "is_genuine_fault", "repair_performed", "repair_confirmed", "actionable")


def answer(raw: Column) -> Column:
    """The JSON from the first brace to the last as VARIANT, null if that is no JSON (or repeats a key)."""
    whole = F.try_parse_json(F.concat(F.lit("["), T.salvage_json(raw), F.lit("]")))  # text behind the object is an error
    return F.try_variant_get(whole, "$[0]", "variant")


def field(v: Column, name: str, kind: str) -> Column:
    """A field of an answer, null unless it is of that kind: boolean or string."""
    is_kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == kind.upper()
    return F.when(is_kind, F.try_variant_get(v, f"$.{name}", kind))


def structured_verdict(raw: Column) -> Column:
    """struct<parse_fail, passed, failed, reason>: every condition must be there, strictly boolean, and true."""
    v = answer(raw)
    given = {c: field(v, c, "boolean") for c in CONDITIONS}
    parse_fail = F.lit(False)
    for c in CONDITIONS:
        parse_fail = parse_fail | given[c].isNull()
    failed, why = F, F
    for c in CONDITIONS:
        failed = failed.when(~given[c], c)
        said = F.trim(field(v, f"reasons.{c}", "string"))
        why = why.when(~given[c], F.when(said != "", said).otherwise("no reason given"))
    failed = F.when(~parse_fail, failed.otherwise(None))
    reason = F.when(parse_fail, None).when(failed.isNotNull(), F.concat(F.lit("failed:"), failed, F.lit(" — "), why.otherwise(None))).otherwise("Verified by independent AI auditor")
    return F.struct(parse_fail.alias("parse_fail"), (~parse_fail & failed.isNull()).alias("passed"), failed.alias("failed"), reason.alias("reason"))


def _clause(v: Column) -> Column:
    given = field(v, "failed_condition", "string")
    return F.when(given.rlike("^[a-e]$"), given).otherwise("none")


def precision_verdict(raw: Column) -> Column:
    """struct<parse_fail, wrongly_accepted, confidence, failed_condition, reason>; what is no answer accuses nobody."""
    v = answer(raw)
    bad = v.isNull()
    return F.struct(
        bad.alias("parse_fail"),
        F.coalesce(field(v, "wrongly_accepted", "boolean"), F.lit(False)).alias("wrongly_accepted"),
        F.when(~bad, F.coalesce(field(v, "confidence", "string"), F.lit("unknown"))).alias("confidence"),
        _clause(v).alias("failed_condition"),
        F.when(bad, "unparseable").otherwise(F.left(F.coalesce(field(v, "reason", "string"), F.lit("")), F.lit(200))).alias("reason"),
    )


def triage_verdict(raw: Column) -> Column:
    """struct<parse_fail, wrongly_accepted, confidence, failed_condition, reason, clear>; what is no answer is disputable.

    Clear: no clause is named and nothing is wrongly accepted; the model's confidence is not asked.
    """
    v = answer(raw)
    bad = v.isNull()
    wrong = F.when(bad, True).otherwise(F.coalesce(field(v, "wrongly_accepted", "boolean"), F.lit(False)))
    sure = field(v, "confidence", "string")
    return F.struct(
        bad.alias("parse_fail"),
        wrong.alias("wrongly_accepted"),
        F.when(sure.rlike("^(low|medium|high)$"), sure).otherwise("low").alias("confidence"),
        _clause(v).alias("failed_condition"),
        F.left(F.coalesce(field(v, "reason", "string"), F.lit("")), F.lit(240)).alias("reason"),
        (~bad & ~wrong & (_clause(v) == "none")).alias("clear"),
    )


def triaged(cases: DataFrame) -> DataFrame:
    """`cases` (raw) with verdict and outcome: clear ones are approved, all others go to a person."""
    judged = cases.withColumn("verdict", triage_verdict(F.col("raw")))
    return judged.withColumn("outcome", F.when(F.col("verdict.clear"), "approved").otherwise("queued"))


# ---- second looks at bulletins

#: Repairs that are a decision tree, as the second pass and as the subset's validation read them.
CONDITIONAL_SUBSET = (r"\bas needed\b", r"\bif necessary\b", r"\bif the concern persists\b", r"\bif concern persists\b", r"\bif concern remains\b", r"\bif the issue persists\b", r"\bif issue persists\b", r"\bif symptoms persist\b", r"\bif .* found\b", r"\bif .* damaged\b", r"\bif .* out of spec\b", r"\bif .* cannot be established\b", r"\bthen replace\b")
CONDITIONAL = (*CONDITIONAL_SUBSET, r"\bif the vehicle still\b")
#: Tags too generic to find a case by.
GENERIC_SYMPTOMS = ("inoperative", "warning light", "mil on", "noise", "vct dtcs", "lack of power", "wrench indicator")
#: Software repairs, serious faults and matters of comfort.
SOFTWARE = (r"\breprogram\b", r"\bupdate\b", r"\bflash\b")
SERIOUS = (r"\bdtc\b", r"\bno start\b", r"\bstall\b", r"\bwon't start\b", r"\boverheat\b", r"\bleak\b", r"\blimp\b", r"\bmisfire\b", r"\binoperative\b", r"\bcharging\b", r"\bbattery\b", r"\bpower steering\b", r"\bengine coolant over temperature\b")
COMFORT = (r"\beta\b", r"\bsync\b", r"\bnavigation\b", r"\bambient\b", r"\bdisplay\b", r"\bmessage\b", r"\bphone\b", r"\bconnected service\b", r"\bdeep sleep\b", r"\bperformance issues\b")
COMFORT_TAGS = ("sync performance issues", "false deep sleep notification", "inaccurate deep sleep notification")


def _tags(symptoms: Column) -> Column:
    return F.filter(F.transform(F.coalesce(symptoms, F.array().cast("array<string>")), clean), lambda s: s != "")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(clean(text), " "), lambda w: w != ""))


def conditional(resolution: Column, patterns: tuple[str, ...] = CONDITIONAL) -> Column:
    return B.any_of(clean(resolution), patterns)


def weak_software_only(symptoms: Column, description: Column, resolution: Column) -> Column:
    """A software repair of a matter of comfort, without any sign of a serious fault."""
    about = clean(description)
    comfort = B.any_of(about, COMFORT) | F.exists(_tags(symptoms), lambda s: F.lower(s).isin(*COMFORT_TAGS))
    return B.any_of(clean(resolution), SOFTWARE) & ~B.any_of(about, SERIOUS) & comfort


def second_pass(decisions: DataFrame) -> DataFrame:
    """`decisions` (decision, symptoms, description, resolution, reason) with accepts that a guard stops sent to review."""
    tags = _tags(F.col("symptoms"))
    guards = (
        (F.size(tags) == 0, "Second pass downgraded accept: empty symptoms after normalization."),
        (F.exists(tags, lambda s: F.lower(s).isin(*GENERIC_SYMPTOMS)), "Second pass downgraded accept: symptom tag is too generic for diagnostic retrieval."),
        (conditional(F.col("resolution")), "Second pass downgraded accept: repair action is conditional or decision-tree based."),
        (weak_software_only(F.col("symptoms"), F.col("description"), F.col("resolution")), "Second pass downgraded accept: software-only comfort/convenience bulletin is too weak for closed-case retrieval."),
    )
    stopped = F
    for holds, why in guards:
        stopped = stopped.when((F.col("decision") == "accept") & holds, why)
    out = decisions.withColumn("__why", stopped.otherwise(None))
    return out.withColumns({"decision": F.when(F.col("__why").isNotNull(), "review").otherwise(F.col("decision")), "reason": F.coalesce("__why", "reason")}).drop("__why")


#: Repairs that only point at a procedure; the refining pass knows more of them.
GENERIC_RESOLUTION = (r"^follow the service procedure\b", r"^follow the bulletin(?: repair)? procedure\b", r"^refer to\b", r"^see bulletin\b", r"^perform service action\b", r"^this (?:service|technical) bulletin provides repair information\b", r"^this (?:service|technical) bulletin provides a repair procedure\b")
GENERIC_REVIEWED = (*GENERIC_RESOLUTION, r"^this preliminary information communicates\b", r"^this bulletin announces the availability of new reprogramming files\b")
GENERIC_REFINED = (*GENERIC_RESOLUTION, r"^inspect\b", r"^check\b", r"^verify\b", r"^torque\b", r"^clean and lubricate\b")
#: Faults worth keeping whatever else is said, and nuisances.
HIGH_VALUE = (
    r"\bdtc\b", r"\bmil\b", r"\bno start\b", r"\bwon['’]?t start\b", r"\bstall\b", r"\bloss of propulsion\b", r"\breduced power\b", r"\blimp mode\b", r"\bpoor acceleration\b", r"\boverheat(?:ing)?\b", r"\bleak\b", r"\bbrake fluid\b", r"\bbrake assist\b", r"\bhard brake pedal\b", r"\bincorrect gear ratio\b", r"\bslipping\b", r"\bjerking\b",
    r"\brough shifts?\b", r"\bno charge\b", r"\bunable to charge\b", r"\bbattery dead\b", r"\bdead battery\b", r"\binoperative\b", r"\bremote start inoperative\b", r"\bstart\/stop inoperative\b", r"\bengine runs cold\b", r"\bno cabin heat\b",
)
LOW_VALUE = (
    r"\bnoise\b", r"\brattle\b", r"\bclunk\b", r"\bsqueak\b", r"\bwhin(?:e|ing)\b", r"\bmoan\b", r"\bgrinding\b", r"\bscrap(?:e|ing)\b", r"\bvibration\b", r"\bharsh ride\b", r"\bpopping\b", r"\bflutter\b", r"\bticking\b", r"\bmanual door lock\b", r"\bheated seat\b", r"\bsunshade\b", r"\bpower folding mirror\b", r"\bsharp curve warning\b",
    r"\bwater leak center stack\b", r"\broof rattle\b", r"\bwindow operation\b", r"\bwheel bearing noise\b", r"\bess inoperative\b", r"\bcheck gas cap\b",
)


def refined(seeds: DataFrame) -> DataFrame:
    """`seeds` (symptoms, description, resolution, summary_raw, resolved) with stage and reason: ready or review."""
    tags, about, fix = _tags(F.col("symptoms")), clean(F.col("description")), clean(F.col("resolution"))
    text = F.concat_ws(" ", F.array_join(tags, " "), about, fix, clean(F.col("summary_raw")))
    rules = (
        (~F.coalesce("resolved", F.lit(False)), "Catalog mapping unresolved or missing."),
        ((about == "") | (fix == "") | (F.size(tags) == 0), "Seed is missing core case fields after coarse extraction."),
        (F.exists(tags, lambda s: _words(s) > 4), "Symptom tags are too verbose for high-confidence refined ready."),
        (B.any_of(fix, GENERIC_REFINED), "Resolution still looks like procedural or generic bulletin guidance."),
        (B.any_of(text, LOW_VALUE) & ~B.any_of(text, HIGH_VALUE), "Low-value NVH/comfort/nuisance case moved out of refined ready."),
    )
    reason = F
    for holds, why in rules:
        reason = reason.when(holds, why)
    rows = seeds.withColumn("reason", reason.otherwise(""))
    return rows.withColumn("stage", F.when(F.col("reason") == "", "ready").otherwise("review"))


#: What shows that a text is a bulletin's own, and the repairs that can be acted on.
RAW_BULLETIN = (r"^(?:some|certain|these)\b", r"this (?:service|technical) bulletin", r"\bproduced from\b|\bequipped with\b|\bbuilt on\b")
ACTIONABLE = (r"\b(?:replace|repair|reprogram|update|adjust|install|inspect|tighten|clean|reseal|torque|bleed|flush)\b",)


def normalized_decision(raw: Column) -> Column:
    """struct<decision, symptoms, description, resolution, reason> of a reviewer's answer.

    An accept stays one only if all four findings are true and what is left is a case: tags of four words at most, a
    description and an own, actionable repair, neither of them a bulletin's text.  The answer is parsed and its fields
    are read once, and every later step is bound.
    """
    text = lambda v, name: clean(field(v, name, "string"))

    def read(v: Column) -> Column:
        found = F.lit(True)
        for name in ("is_relevant", "has_clear_symptoms", "has_clear_resolution", "matches_case_structure"):
            found = found & F.coalesce(field(v, name, "boolean"), F.lit(False))
        given = F.coalesce(F.try_variant_get(v, "$.cleaned_symptoms", "array<string>"), F.array().cast("array<string>"))
        said = F.lower(text(v, "decision"))
        parts = {"said": said, "tags": _tags(given), "about": text(v, "cleaned_description"), "fix": text(v, "cleaned_resolution"), "why": text(v, "reason"), "found": found}
        return F.struct(*(c.alias(n) for n, c in parts.items()))

    raw_text = lambda t: (t == "") | (F.length(t) > 240) | B.any_of(t, RAW_BULLETIN)

    def judged(p: Column, a: Column, t: Column) -> Column:
        fix = p["fix"]
        sound = p["found"] & (F.size(t) > 0) & F.forall(t, lambda s: _words(s) <= 4) & (F.length(a) >= 12) & (F.length(fix) >= 10)
        sound = sound & ~raw_text(a) & ~raw_text(fix) & (F.lower(a) != F.lower(fix)) & ~B.any_of(fix, GENERIC_REVIEWED) & B.any_of(fix, ACTIONABLE)
        known = F.when(p["said"].isin("accept", "reject", "review"), p["said"]).otherwise("review")

        def decided(unsound: Column) -> Column:
            reason = F.when(unsound & (p["why"] == ""), "AI marked accept, but normalized output still failed structural validation.").otherwise(p["why"])
            return F.struct(F.when(unsound, "review").otherwise(known).alias("decision"), t.alias("symptoms"), a.alias("description"), fix.alias("resolution"), reason.alias("reason"))

        return X.let((known == "accept") & ~sound, decided)

    def whole(p: Column) -> Column:
        about = F.when(p["about"] != "", p["about"]).otherwise(F.coalesce(F.get(p["tags"], F.lit(0)), F.lit("")))
        # each step is bound: a tag that several rules look at is worked out once
        first = lambda a: X.symptom_tags(p["tags"], a)
        final = lambda a: X.let(first(a), lambda t: X.let(X.without_generic(t, a, a), lambda u: X.beside_codes(u, a, a)))
        return X.let(about, lambda a: X.let(final(a), lambda t: judged(p, a, t)))

    return X.let(X.let(answer(raw), read), whole)


def catalog_enforced(decisions: DataFrame) -> DataFrame:
    """An accept (decision, reason) of a vehicle that the catalog has not resolved goes to review."""
    bad = (F.col("decision") == "accept") & ~F.coalesce("resolved", F.lit(False))
    why = "AI marked accept, but catalog mapping is unresolved and requires manual catalog confirmation first."
    return decisions.withColumns({"reason": F.when(bad, why).otherwise(F.col("reason")), "decision": F.when(bad, "review").otherwise(F.col("decision"))})


def subset_summary(seeds: DataFrame) -> DataFrame:
    """One row: what a subset (local_id, vehicle_brand, vehicle_model, symptoms, obd_codes, description, resolution, resolved) breaks.

    Long tags and code tags beside listed codes count each, the others per seed; an empty subset is not approved.
    """
    tags, codes = _tags(F.col("symptoms")), _tags(F.col("obd_codes"))
    blank = lambda c: clean(F.col(c)) == ""
    like_code = lambda s: s.rlike(r"(?i)^DTCs?\b|^[PCUB][0-9A-F]{4,6}\b")
    missing = blank("local_id") | blank("vehicle_brand") | blank("vehicle_model") | (F.size(tags) == 0) | blank("description") | blank("resolution")
    sums = {
        "long_symptom_tags": F.size(F.filter(tags, lambda s: _words(s) > 4)),
        "redundant_dtc_symptom_hits": F.when(F.size(codes) > 0, F.size(F.filter(tags, like_code))).otherwise(0),
        "unresolved_catalog_mapping": (~F.coalesce("resolved", F.lit(False))).cast("int"),
        "conditional_resolutions": conditional(F.col("resolution"), CONDITIONAL_SUBSET).cast("int"),
        "missing_core_fields": missing.cast("int"),
    }
    lower = lambda c: F.lower(clean(F.col(c)))
    key = F.array(lower("vehicle_brand"), lower("vehicle_model"), F.lower(F.array_join(codes, ",")), lower("description"), lower("resolution"))
    keyed = seeds.select(key.alias("key"), *(v.alias(k) for k, v in sums.items()))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in sums))
    again = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = groups.agg(zero("n").alias("seed_count"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), zero(again).alias("duplicate_rows"), *(zero(k).alias(k) for k in sums))
    clear = (F.col("seed_count") > 0) & (F.col("duplicate_groups") == 0)
    for k in sums:
        clear = clear & (F.col(k) == 0)
    return row.withColumns({"empty_subset": (F.col("seed_count") == 0).cast("int"), "approved": clear})


# ---- what is safe to import

#: What titles, descriptions and repairs say that are no faults.
NO_FAULT_TITLE = (r"\bandroid\s+auto\b", r"\bled\s+[^\n]*\bm[ií]sto\b", r"\breset\s+servisn[ií]ho\s+intervalu\b", r"\belektrick[eé]\s+vyh[řr][ií]v[aá]n[ií]\s+[čc]eln[ií]ho\s+okna\b", r"\bolejov[aá]\s+vana\b", r"\bp[řr]elit[ií]\s+mno[zž]stv[ií]\s+oleje\b", r"\bv[ýy]dr[zž]\s+baterie\b", r"\bk[óo]dov[aá]n[ií]\b", r"\bsound\s+syst[eé]m\b")
NO_FAULT_DESCRIPTION = (r"\bconsidering\b", r"\bdoes not have a humidity sensor\b", r"\bsuccessfully installed a heated windshield\b", r"\bpurchased recommended led bulbs\b", r"\buser extracted half a liter of oil\b", r"\bprocedure:\s*1\.")
NO_FAULT_RESOLUTION = (r"\brecommends the bulbs\b", r"\bsucceeded using the procedure\b", r"\binstalled a heated windshield\b", r"\bdisables window operation but prevents the issue\b", r"\beverything is ok since then\b")
#: Families of models that must not be mixed up.
FAMILIES = ("citigo", "fabia", "rapid", "roomster", "octavia", "superb", "yeti", "scala", "kamiq", "karoq", "kodiaq", "enyaq")
#: Weak repairs as (pattern, fewer characters than), by variant; and the worth of sources.
WEAK = (("^it works\\b", 25), ("^everything is ok\\b", 40), ("^fault removed\\b", 35), ("recommend", None), ("succeeded using the procedure", None), (r"everything was okay\.?$", 80))
WEAK_FOLDED = ("disconnected .* prevents the issue", "problem practically disappeared")
WEAK_BY_AUTHOR = (("^problem sorted\\b", None), ("sorted itself out", None), ("appears to have been sorted", None), (r"poor connection\.?$", 40), (r"fixed now\.?$", 35))
SOURCES = {"ready": 2, "retry_extractor_promoted": 1, "retry_classifier_promoted": 1, "to_review_promoted": 1}
SOURCES_BY_AUTHOR = {"ready_import_only": 3, "model_resolution_fetch_promoted": 2}


def weak_resolution(resolution: Column, folded: Column, by_author: bool = False) -> Column:
    """Whether a repair says too little; `folded` is its text by `fold_words`."""
    plain = F.trim(F.coalesce(resolution, F.lit("")))
    weak = folded == ""
    for pattern, below in WEAK_BY_AUTHOR if by_author else WEAK:
        holds = plain.rlike(f"(?i){pattern}")
        weak = weak | (holds & (F.length(plain) < below) if below else holds)
    if by_author:
        return weak | F.contains(folded, F.lit("implied repair")) | plain.rlike(r"^faulty pump\.?$")
    return weak | folded.rlike("(?i)" + "|".join(WEAK_FOLDED))


def family(folded: Column) -> Column:
    """The first family, in their order, that stands in a folded text; else empty."""
    out = F
    for name in FAMILIES:
        out = out.when(F.contains(folded, F.lit(name)), name)
    return out.otherwise("")


def safe_final(cases: DataFrame, catalog: DataFrame, by_author: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases with issues and safe, (seq, issue) of all) of curated cases against the catalog's labels (label).

    `cases`: seq, source_bucket, thread_url, thread_title, vehicle_model, model_raw, case_author, symptoms, description,
    resolution.  Of exact duplicates the better source stays, then (by_author) the longer repair, then the first; an
    issue names each other one.  A case with any issue is not safe.

    Winners and an author's cases in a thread are aggregates that are joined back: no group is held in one task.
    """
    fold = lambda c: T.fold_words(F.coalesce(F.col(c), F.lit("")))
    rows = cases.withColumns({"__fix": T.fold_words(clean(F.col("resolution"))), "__model": fold("vehicle_model"), "__raw": fold("model_raw"), "__author": fold("case_author")})
    names = SOURCES_BY_AUTHOR if by_author else SOURCES
    worth = F.lit(1 if by_author else 0)
    for name, n in names.items():
        worth = F.when(F.col("source_bucket") == name, n).otherwise(worth)
    length = F.length(F.coalesce("resolution", F.lit(""))) if by_author else F.lit(0)
    key = [F.coalesce("thread_url", F.lit("")), F.array_join(T.fold_each("symptoms"), "|"), F.col("__fix"), *([F.col("__author")] if by_author else [])]
    rows = rows.withColumns({"__key": F.sha2(F.concat_ws("\x1f", *key), 256), "__rank": F.struct((-worth).alias("a"), (-length).alias("b"), F.col("seq").alias("c"))})
    best = rows.groupBy("__key").agg(F.min("__rank").alias("__best"))
    met = rows.join(best, "__key").withColumn("__first", F.col("__rank") == F.col("__best")).drop("__best")
    labels = catalog.select(fold("label").alias("__label")).where("__label <> ''").distinct().withColumn("__known", F.lit(True))
    met = met.join(labels, met["__model"] == labels["__label"], "left")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rules = {
        "missing_thread_identity": ~given("thread_url") | ~given("thread_title"),
        "model_not_in_catalog": ~given("vehicle_model") | F.col("__known").isNull(),
        "missing_symptoms": F.coalesce(F.size("symptoms"), F.lit(0)) < 1,
        "missing_description": F.trim(F.coalesce("description", F.lit(""))) == "",
        "missing_resolution": F.trim(F.coalesce("resolution", F.lit(""))) == "",
        "weak_resolution": weak_resolution(F.col("resolution"), F.col("__fix"), by_author),
    }
    if by_author:
        model = F.when(F.col("__known"), F.col("__model")).otherwise(F.coalesce("vehicle_model", F.lit("")))
        several = met.where("__first").groupBy("thread_url", "__author").agg(F.count(F.lit(1)).alias("__many"), F.count_distinct(model).alias("__models"))
        several = several.select(F.col("thread_url").alias("__url"), F.col("__author").alias("__by"), "__many", "__models")
        met = met.join(several, met["thread_url"].eqNullSafe(several["__url"]) & (met["__author"] == several["__by"]), "left")
        rules |= {"broad_vehicle_label": F.coalesce("vehicle_model", F.lit("")).rlike(r"(?i)\bTransit / Tourneo\b"), "same_author_multi_case_thread": F.col("__many") > 1, "same_author_conflicting_model": F.col("__models") > 1}
    else:
        raw, own = family(F.col("__raw")), family(F.col("__model"))
        rules |= {
            "model_context_conflict": (raw != "") & (own != "") & (raw != own),
            "non_fault_title": B.any_of(F.col("thread_title"), NO_FAULT_TITLE),
            "non_fault_description": B.any_of(F.col("description"), NO_FAULT_DESCRIPTION),
            "non_fault_resolution": B.any_of(F.col("resolution"), NO_FAULT_RESOLUTION),
        }
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    judged = met.withColumn("issues", F.when(F.col("__first"), named).otherwise(F.array(F.lit("exact_duplicate_case"))))
    judged = judged.select(*cases.columns, "issues", (F.size("issues") == 0).alias("safe"))
    return judged, judged.select("seq", F.explode("issues").alias("issue"))


def retriaged(reviews: DataFrame) -> DataFrame:
    """`reviews` (stage, model, ready, should_seed, has_confirmed_resolution, has_required_fields) with final_status, by stage.

    `ready`: whether the rebuilt record passes the gate of ready ones.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    modelled = F.coalesce(F.col("model"), F.lit("")) != ""
    record = F.when(modelled & yes("ready"), "promote_ready_candidate").when(~modelled, "model_resolution_needed").otherwise("record_hold")
    weak_fields = yes("should_seed") & yes("has_confirmed_resolution") & no("has_required_fields")
    classifier = F.when(weak_fields, "manual_review_classifier").when(no("has_confirmed_resolution"), "reject_no_confirmed_resolution").otherwise("manual_review_classifier")
    status = F.when(F.col("stage") == "record", record).when(F.col("stage") == "extractor", "manual_extraction_needed").when(F.col("stage") == "classifier", classifier)
    return reviews.withColumn("final_status", status.otherwise("unclassified_review_item"))


# ---- a review that is resumed


def logged(lines: DataFrame) -> DataFrame:
    """(path, decision, symptoms, description, resolution, reason) of a decision log's `lines` (value), normalized anew.

    Lines that are blank or no JSON object are passed over; a line without a path counts but finishes nothing.
    """
    v = F.try_parse_json(F.trim("value"))
    rows = lines.select(v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    said = F.to_json(F.try_variant_get(F.col("v"), "$.decision", "variant"))
    return rows.select(F.nullif(field(F.col("v"), "source_path", "string"), F.lit("")).alias("path"), normalized_decision(said).alias("d")).select("path", "d.*")


def resumed(work: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(`work` (path, ...) that the log lacks, the accepted decisions, one row of counts)."""
    log = logged(lines)
    left = work.join(log.where("path is not null").select("path").distinct(), "path", "left_anti")
    counts = log.agg(F.count(F.lit(1)).alias("reviewed"), *(F.count_if(F.col("decision") == d).alias(n) for d, n in (("accept", "accepted"), ("review", "review"), ("reject", "rejected"))))
    return left, log.where("decision = 'accept'"), counts
