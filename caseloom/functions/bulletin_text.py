"""What a bulletin's summary says: its concern, remedy, codes and symptom tags, as column expressions.

Patterns stand in tables of fixed values, in the order in which they count; the first that is met
decides.  A value that several steps look at is bound once by `let`, never repeated in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clean
from .text import obd_codes

#: How titles begin that say nothing, and how other texts do.
TITLE_LEADS = ("technical service bulletin", "service action", "dealer message", "warranty extension", "product improvement campaign", "customer satisfaction campaign")
TEXT_LEADS = (r"^customers may experience the following:\s*", r"^the following:\s*[•●\-]?\s*")
QUOTES = "'\"“”‘’"
FILLERS = r"\b(?:concerns?|issues?|conditions?)\b"

#: Phrases of a summary that name its concern, and what goes from their beginning.
FAILURE = r"\baddresses failures of (?:the )?(.+?)(?:,| as well as| on\b| in\b|\.)"
RELATED = (r"\bconcerns? related to (?:the )?(.+?)(?:\.|,)", r"\brelated to (?:the )?(.+?)(?:\.|,)")
CONCERNS = (
    ((r"\bto remedy (?:an? )?[‘'\"]?(.+?)[’'\"]? (?:concern|issue|condition)\b",), ""),
    ((r"\bmay experience ([^.]+?)(?: concerns?| issues?| conditions?)?(?:\.|,)",), ""),
    ((r"\bthere could be (.+?)(?:\.| The technician\b| Replace or repair\b)",), r"^an?\s+"),
    ((r"\bto correct (?:a )?customer concern of ([^.]+?)(?:\.|,)", r"\bcorrect (?:a )?customer concern of ([^.]+?)(?:\.|,)"), ""),
    ((r"\bmay be encountered with (.+?)(?:\.|,)",), r"^there could be\s+"),
    ((r"\bmakes technicians aware of (.+?)(?:\.|,)",), ""),
    ((r"\b(oil leak near the turbocharger)\b",), ""),
)
LAMP = r"\bSES light on\b"
LAMP_REST = r"(\bSES light on.*)"
CODED = (r"\bfollowing Diagnostic Trouble Code \(DTC\):\s*([^.]+?)(?:\.|,)", r"(\bfollowing DTCs.+)$")
MODULES = ((r"\bTransmission Control Module\b|\bTCM\b", " in the transmission control module"), (r"\bHYDRAULIC UNIT ASSEMBLY\b|\bVDC\b", " in the VDC module"))
NUMBERED = (r"\bSYMPTOM 1:\s*([^:]+?)(?:SYMPTOM 2:|SYPMTOM 2:|NOTE:|\.\")", r"\bSYPM?TOM 2:\s*([^:]+?)(?:NOTE:|\.\")")
UNANSWERED = r"\bmay not respond when ([^.]+)\."
ACTIVATED = (r"(\b[a-z0-9\- ]+? function that activates in response to (?:a )?.+?(?:\.|,))", r"(\b[a-z0-9\- ]+? activates in response to (?:a )?.+?(?:\.|,))")
ACTIVATED_AS = ((r"\bfunction that activates\b", "activates"), (r"\b in response to\b", " when "), (r"\bfault detected\b", "fault is detected"))
SENTENCE_LEADS = (
    (r"^the affected .+? may\b", "Vehicle may"), (r"^this preliminary information communicates(?: that| to the technician to)?\s*", ""), (r"^the document makes technicians aware of\s*", ""), (r"^this bulletin announces (?:the )?availability of\s*", ""),
    (r"^this logic was developed to address\s*", ""), (r"^this bulletin provides information to\b", ""),
)
NO_CONCERN = r"\bsoftware update\b|\bimprovement\b"
TOLD = (
    r"\b(?:provides (?:instructions|repair information|the procedure)|dealers are to)\s+(?:on how to remedy|to remedy)\s+(.+?)(?:\.|$)",
    r"\b(?:provides (?:instructions|repair information|the procedure)|dealers are to)\s+to\s+(?:replace|repair|adjust|inspect|install).+?\bwhen\s+(.+?)(?:\.|$)",
)

#: Where a summary states its remedy, and how remedies are put: for targets, and for those that name software.
REMEDY = (r"\bthis bulletin provides (?:information|the procedure) to ([^.]*\.)", r"\bdealers are to ([^.]*\.)", r"\bto remedy ([^.]*\.)")
MAIN_ACTION = r"\b(?:replace|reprogram|update|repair)\b"
NO_REMEDY = r"\bdo not replace\b|\bnot to replace\b"
REMEDIES = (
    ((r"\breplace or repair (?:the )?(.+?)(?: as needed| if needed| when needed|\.|,)",), "Repair or replace the ", " as needed.", None),
    ((r"\breplacement of (?:the )?(.+?)(?: on\b| for\b| in\b| to\b| if\b| when\b|\.|,)",), "Replace the ", ".", None),
    ((r"\breplac(?:e|ed) (?:the )?(.+?)(?: on\b| for\b| in\b| to\b| if\b| when\b| as needed|\.|,)",), "Replace the ", ".", None),
    ((r"\breplacing (?:the )?(.+?)(?: is the solution| will correct| can resolve|\.|,)",), "Replace the ", ".", None),
    ((r"\bupdate the software on (.+?)(?: to remedy| to address|\.|,)", r"\bupdate (?:the )?(.+? software)(?: on certain| on | for | to remedy| to address|\.|,)"), "Update the software on ", ".", "Update the "),
    ((r"\breprogram(?: the)? (.+?)(?: to remedy| to address|\.|,)",), "Reprogram ", ".", None),
    ((r"\breprogramming files for the (.+?)(?:\.|,)",), "Reprogram the ", ".", None),
    ((r"\bavailability of the new (.+?) developed to address",), "Replace the ", ".", None),
)
FILES = r"\breprogramming files\b"
FILE_TARGETS = (("Transmission Control Module (TCM)", MODULES[0][0]), ("HYDRAULIC UNIT ASSEMBLY (VDC)", MODULES[1][0]))
INSPECTED = r"\binspect (?:and repair |and replace )?(.+?)(?: for\b| on\b| in\b|\.|,)"
REMEDY_LEADS = (r"^this bulletin (?:provides information|provides the procedure|describes a procedure|contains instructions) to\s+", r"^dealers are to\s+", r"^to remedy\s+", r"^to address\s+")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def if_any(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a text that isn't empty, else null."""
    return F.get(F.transform(F.filter(F.array(value), lambda x: x != ""), f), F.lit(0))


def some(text: Column) -> Column:
    """A text, null if it is empty; unlike nullif it works the text out once."""
    return F.get(F.filter(F.array(text), lambda x: x != ""), F.lit(0))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _sub(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, f"(?i){pattern}", to)


def _once(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, f"(?i)^(.*?){pattern}", "$1" + to)


def _said(text: Column, *patterns: str) -> Column:
    """What the first of the patterns that is met holds, else empty."""
    return clean(F.coalesce(*(some(F.regexp_extract(text, f"(?i){p}", 1)) for p in patterns), F.lit("")))


def _led(text: Column, leads: tuple[str, ...] = TEXT_LEADS) -> Column:
    for lead in leads:
        text = _sub(text, lead)
    return F.trim(text)


def concern(text: Column) -> Column:
    bare = F.regexp_replace(_sub(_led(clean(text)), FILLERS), "[‘’]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"\s+\.$", ".")


def sentence(text: Column) -> Column:
    """Without quotes and empty beginnings, its first letter a capital."""
    return let(_led(clean(F.regexp_replace(clean(text), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))


def ended(text: Column) -> Column:
    return F.when(text.rlike(r"[.!?]$") | (text == ""), text).otherwise(F.concat(text, F.lit(".")))


def code_phrase(codes: Column) -> Column:
    """DTC A; DTCs A and B; DTCs A, B, and C; null for none."""
    n, last = F.size(codes), F.concat(F.lit("and "), F.get(codes, F.size(codes) - 1))
    many = F.when(n == 2, F.concat_ws(" ", F.get(codes, F.lit(0)), last)).otherwise(F.concat(F.array_join(F.slice(codes, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", "), last))
    return F.when(n == 1, F.concat(F.lit("DTC "), F.get(codes, F.lit(0)))).when(n > 1, F.concat(F.lit("DTCs "), many))


def _end(text: Column) -> Column:
    return F.concat(sentence(text), F.lit("."))


def _ending(lead: str) -> Callable[[Column], Column]:
    return lambda c: _end(_sub(c, lead) if lead else c)


def _put(before: str, after: str, software: str | None) -> Callable[[Column], Column]:
    begin = lambda x: F.lit(before) if software is None else F.when(_has(x, r"\bsoftware\b"), software).otherwise(before)
    return lambda x: F.concat(begin(x), x, F.lit(after))


def _described(title: Column, body: Column, complaint: Column, action_first: str) -> Column:
    """A concise description, empty where nothing serves."""
    related = concern(_said(body, *RELATED))
    failure = if_any(_said(body, FAILURE), lambda f: F.concat(sentence(f), F.lit(" failure"), F.coalesce(if_any(related, lambda r: F.concat(F.lit(" causing "), r)), F.lit("")), F.lit(".")))
    steps = [F.regexp_replace(failure, r"^(.*?)\.\.", "$1.")]
    for patterns, lead in CONCERNS:
        steps.append(if_any(concern(_said(body, *patterns)), _ending(lead)))
    steps.append(F.when(_has(body, LAMP), F.concat(F.lit("SES light on with "), let(obd_codes(_said(body, LAMP_REST)), code_phrase), F.lit("."))))
    where = F
    for pattern, name in MODULES:
        where = where.when(_has(body, pattern), name)
    steps.append(F.concat(let(obd_codes(_said(body, *CODED)), code_phrase), F.lit(" detected"), where.otherwise(""), F.lit(".")))
    second = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.$", ""), r"^A\s+", "a ")
    also = F.coalesce(if_any(concern(_said(body, NUMBERED[1])), lambda c: F.concat(F.lit(" or "), second(c), F.lit("."))), F.lit(""))
    steps.append(if_any(concern(_said(body, NUMBERED[0])), lambda c: let(also, lambda a: F.when(a == "", _end(c)).otherwise(F.concat(sentence(F.regexp_replace(c, r"\.$", "")), a)))))
    steps.append(if_any(concern(_said(body, UNANSWERED)), lambda c: F.concat(F.lit("System does not respond when "), c, F.lit("."))))

    def activated(c: Column) -> Column:
        for pattern, to in ACTIVATED_AS:
            c = _once(c, pattern, to)
        return sentence(c)

    def plainly(s: Column) -> Column:
        for pattern, to in SENTENCE_LEADS:
            s = _sub(s, pattern, to)
        return sentence(s)

    steps.append(if_any(concern(_said(body, *ACTIVATED)), activated))
    steps.append(if_any(complaint, lambda s: let(plainly(s), lambda t: F.when(~_has(t, action_first), t))))
    steps.append(F.when(~_has(title, NO_CONCERN), sentence(title)))
    return F.coalesce(*steps, F.lit(""))


def _remedied(source: Column) -> Column:
    """A concise remedy; empty for none, and where parts are not to be replaced."""
    steps = [if_any(_said(source, *patterns), _put(before, after, software)) for patterns, before, after, software in REMEDIES]
    steps += [F.when(_has(source, FILES) & _has(source, pattern), f"Reprogram the {name}.") for name, pattern in FILE_TARGETS]
    steps.append(if_any(_said(source, INSPECTED), lambda x: F.concat(F.lit("Inspect "), x, F.lit("."))))
    rest = source
    for lead in REMEDY_LEADS:
        rest = _sub(rest, lead)
    return F.when((source == "") | _has(source, NO_REMEDY), "").otherwise(F.coalesce(*steps, F.trim(let(rest, ended))))


def seed_parts(summary: Column, shows: str, acts: str, action_first: str) -> Column:
    """struct<description, resolution, symptoms, obd_codes, title, body> of a bulletin's summary.

    `shows`, `acts` and `action_first` are the patterns of symptoms, of actions, and of texts that
    begin with one.  A null or empty summary gives empty parts.
    """

    def told(text: Column) -> Column:
        cut = F.instr(text, " - ")
        title = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
        body = F.when(cut > 0, clean(F.substring(text, cut + 3, F.length(text)))).otherwise(text)
        return F.struct(_led(clean(title), tuple(rf"^{lead}:\s*" for lead in TITLE_LEADS)).alias("title"), body.alias("body"))

    def split(tb: Column) -> Column:
        sentences = F.filter(F.transform(F.split(tb["body"], r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")
        return let(sentences, lambda s: F.struct(
            tb["title"].alias("title"),
            tb["body"].alias("body"),
            F.coalesce(F.get(F.filter(s, lambda x: _has(x, shows)), F.lit(0)), F.lit("")).alias("complaint"),
            F.coalesce(F.get(F.filter(s, lambda x: _has(x, MAIN_ACTION)), F.lit(0)), F.get(F.filter(s, lambda x: _has(x, acts)), F.lit(0)), F.lit("")).alias("action"),
            F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first"),
        ))

    def whole(p: Column) -> Column:
        title, body = p["title"], p["body"]
        fallback = F.coalesce(*(some(c) for c in (p["complaint"], title, p["first"])), body)
        when = if_any(sentence(_said(body, *TOLD)), ended)
        about = F.coalesce(when, some(_described(title, body, p["complaint"], action_first)), clean(fallback))
        remedy = F.coalesce(*(some(_said(body, r)) for r in REMEDY), p["action"])
        return let(about, lambda d: F.struct(
            d.alias("description"),
            let(remedy, _remedied).alias("resolution"),
            F.filter(F.array(d), lambda x: x != "").alias("symptoms"),
            obd_codes(F.concat_ws(" ", title, body)).alias("obd_codes"),
            title.alias("title"),
            body.alias("body"),
        ))

    return let(let(let(clean(summary), told), split), whole)


#: What a symptom's words must hold, all of it, for its tag; those before and behind the rule on codes.
FAILS = r"(?:does not|won['’]?t)"
TAGS_FIRST = (
    ("Door glass won't drop", (rf"\bdoor glass\b.*\b{FAILS}\s+drop\b",)), ("Fuel lid won't lock", (rf"\bfuel(?:-filler)? lid\b.*\b{FAILS}\s+lock\b",)), ("Liftgate won't close", (rf"\bpower liftgate\b.*\b{FAILS}\s+close\b",)), ("Liftgate won't open", (rf"\bpower liftgate\b.*\b{FAILS}\s+open\b",)),
    ("TBM battery fault", (r"\btelematics box module\b|\bTBM\b", r"\bbackup battery\b")), ("12V battery fault", (r"\b12V\b.*\bbattery\b|\b12-volt\b.*\bbattery\b",)), ("ITM fault", (r"\bintegrated thermal management\b|\bITM\b",)), ("Battery monitor fault", (r"\bbattery monitor module\b",)),
    ("Active grille shutter fault", (r"\bactive grille air shutter\b",)), ("Stuck in Park", (r"\bshift out of park\b",)), ("Torque converter clutch fault", (r"\btorque converter(?: damper)? clutch\b", r"\b(?:lack of engagement|won['’]?t engage|does not engage|not engage)\b")), ("Engine misfire", (r"\bcarbon fouling\b", r"\bmisfire\b")),
    ("Seat warmer inoperative", (rf"\bseat warmer\b.*\b{FAILS}\s+operate\b",)), ("Window won't open", (rf"\bwindow\b.*\b{FAILS}\s+open\b",)),
)
TAGS_NEXT = (
    ("Uconnect service message", (r"uconnect box requires service",)), ("MIL on", (r"\bmalfunction indicator lamp\b|\bMIL\b",)), ("Warning light", (r"\bwarning light\b",)), ("BSM fault", (r"\bblind spot monitor\b|\bBSM\b",)), ("Rear lighting fault", (r"\brear lighting\b|\bbrake light\b|\btaillight\b|\bturn indicator\b",)),
    ("Rear seat unlocked", (r"\brear seat\b.*\bnot\b.*\blocked\b",)), ("Loose door handle", (r"\bdoor handle\b", r"\bnot sit flush\b|\bmove slightly\b|\bmisaligned\b|\bloose\b")), ("Harsh downshift", (r"\bharsh downshift\b",)), ("Clicking noise", (r"\bclicking noise\b",)), ("HVAC blower noise", (r"\bblower noise\b|\bHVAC\b.*\bnoise\b",)),
    ("Fuel door stuck", (r"\bfuel door\b.*\bnot open\b|\bfuel door\b.*\bwon['’]?t open\b",)), ("No start", (r"\bno start\b|\bwon['’]?t start\b",)), ("Battery drain", (r"\bbattery drain\b|\bparasitic drain\b",)), ("Musty odor", (r"\bmusty odor\b",)),
)
QUOTED = r"[\"“]([^\"”]{3,80})[\"”]"
CODE_FIRST = r"^(?:diagnostic trouble codes?|dtcs?|fault codes?)"
LONG_CODE = r"\b([PCUB][0-9A-F]{4,6})(?:[-/][0-9A-F]{1,3})?\b"
DEAD = (r"^(?:the )?", ""), (r"\bis inoperative\b.*$", " inoperative"), (r"\binoperative\b.*$", " inoperative")
SHOWN = (r"^(?:check control message for|check control message indicates|vehicle displays|vehicle shows|customer reports|customer states that (?:he/she )?sees?)\s+", ""), (r"\bis displayed\b.*$", " message"), (r"\bdisplayed\b.*$", " message")
CIRCUMSTANCES = (r"^(?:vehicle exhibits|vehicle displays|vehicle shows|customer reports|customer states that (?:he/she )?sees?)\s+", ""), *((rf"\b{w}\b.*$", "") for w in ("when", "while", "during", "with", "due to", "caused by")), (r"[.,;:]+$", "")
RAW = r"^(?:some|certain|these)\b|this (?:service|technical) bulletin|\bproduced from\b|\bequipped with\b|\bbuilt on\b"
RAW_LENGTH, MOST_WORDS, MOST_TAGS = 240, 4, 4
GENERIC_TAGS = ("MIL on", "Warning light")
CODE_TAG = r"^DTCs?\b|^[PCUB][0-9A-F]{4,6}\b"


def words(text: Column, most: int = MOST_WORDS) -> Column:
    return F.array_join(F.slice(F.filter(F.split(clean(text), " "), lambda w: w != ""), 1, most), " ")


def _cut(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        text = _sub(text, pattern, to)
    return text


def code_tag(text: Column) -> Column:
    """DTC A, or DTCs with up to four; null for none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(clean(text), F.lit(f"(?i){LONG_CODE}"), F.lit(1)), F.upper))
    return let(found, lambda c: F.when(F.size(c) == 1, F.concat(F.lit("DTC "), F.get(c, F.lit(0)))).when(F.size(c) > 1, F.concat(F.lit("DTCs "), F.array_join(F.slice(c, 1, MOST_TAGS), "/"))))


def symptom_tag(text: Column) -> Column:
    """A symptom in at most four words; empty for none."""

    def quoted(q: Column) -> Column:
        bare = words(F.trim(_sub(q, r"\bmessage\b")), 3)
        return F.when(_has(q, TAGS_NEXT[0][1][0]), TAGS_NEXT[0][0]).when(_has(q, "not available"), bare).otherwise(words(q))

    def tag(t: Column) -> Column:
        holds = lambda rules: [F.when(_all(t, patterns), name) for name, patterns in rules]
        code = code_tag(t)
        return F.coalesce(
            if_any(_said(t, QUOTED), lambda q: some(quoted(q))),
            *holds(TAGS_FIRST),
            F.when(_has(t, CODE_FIRST), code),
            *holds(TAGS_NEXT),
            F.when(_has(t, r"\binoperative\b"), words(_cut(t, DEAD), 3)),
            F.when(_has(t, r"\bmessage\b"), words(_cut(t, SHOWN))),
            code,
            words(_cut(t, CIRCUMSTANCES)),
        )

    return let(F.trim(F.regexp_replace(clean(text), r"^[•\-–\s]+", "")), tag)


def _all(text: Column, patterns: tuple[str, ...]) -> Column:
    holds = _has(text, patterns[0])
    for p in patterns[1:]:
        holds = holds & _has(text, p)
    return holds


def _short(tag: Column) -> Column:
    return (tag != "") & (F.size(F.split(tag, " ")) <= MOST_WORDS)


def symptom_tags(symptoms: Column, description: Column) -> Column:
    """Up to four distinct tags of the symptoms, or of the description where there are none or none serves."""
    given = F.coalesce(symptoms, F.array().cast("array<string>"))
    source = F.when(F.size(given) > 0, given).otherwise(F.array(description))
    fits = lambda t: _short(t) & (F.length(t) <= RAW_LENGTH) & ~_has(t, RAW)
    tags = F.slice(F.array_distinct(F.filter(F.transform(source, symptom_tag), fits)), 1, MOST_TAGS)
    return let(tags, lambda t: F.when(F.size(t) > 0, t).otherwise(F.filter(F.array(symptom_tag(description)), _short)))


def _strings(symptoms: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(symptoms, F.array().cast("array<string>")), clean), lambda s: s != ""))


def without_generic(symptoms: Column, description: Column, summary: Column) -> Column:
    """Tags without generic ones; where there are only such, tags of the description and the summary instead."""
    specific = lambda tags: F.filter(tags, lambda t: ~t.isin(*GENERIC_TAGS))
    derived = specific(symptom_tags(F.array(description, summary), description))
    other = lambda s: let(derived, lambda d: F.when(F.size(d) > 0, d).otherwise(s))
    return let(_strings(symptoms), lambda s: let(specific(s), lambda k: F.when(F.size(k) > 0, k).otherwise(other(s))))


def beside_codes(symptoms: Column, description: Column, summary: Column) -> Column:
    """Tags that are all codes get those of the description and the summary before them."""
    plain = lambda t: ~_has(t, CODE_TAG) & ~t.isin(*GENERIC_TAGS)
    derived = F.filter(symptom_tags(F.array(description, summary), description), plain)
    only = lambda s: (F.size(s) > 0) & F.forall(s, lambda t: _has(t, CODE_TAG))
    return let(_strings(symptoms), lambda s: F.when(only(s), F.array_distinct(F.concat(derived, s))).otherwise(s))


def without_codes(symptoms: Column, codes: Column) -> Column:
    """Tags that are codes go where the codes are listed anyway."""
    return let(_strings(symptoms), lambda s: F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, F.filter(s, lambda t: ~_has(t, CODE_TAG))).otherwise(s))
