"""Bulletin records from summary to stage: extraction, symptom tags, decisions, engine technology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bulletin_text as X
from ..functions import vehicles as V
from ..operators import faults, gates
from .domain import rows_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _join(patterns) -> str:
    """Patterns as one; those with a look ahead, which SQL's engine lacks, match no summary here."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns if "(?!" not in p)


#: Summaries in which each rule decides once at least; {} is a part's name.
SUMMARIES = (
    "Dealer Message: {} - This bulletin addresses failures of the {} module, on some cars. It has concerns related to the dark screen. Replace the {} assembly if needed.",
    "{} software - Dealers are to update the software on the {} to remedy a 'frozen screen' condition. Reboot it.",
    "Some owners may experience a loud {} noise concern, at low speed. The technician should inspect and repair the {} for cracks.",
    "There could be a leak at the {}. The technician is to replace or repair the {} hose as needed.",
    "Procedure to correct a customer concern of {} rattle, heard when cold. Replacement of the {} bracket will fix it.",
    "A stall may be encountered with there could be a worn {} seal, in winter. Replacing the {} seal is the solution.",
    "This document makes technicians aware of an oil stain near the {}. Clean it.",
    "Check the oil leak near the turbocharger and the {}",
    "SES light on with P0301, p0302 and P0303 after {} work. Reprogram the {} to address it.",
    "New reprogramming files detect the following Diagnostic Trouble Code (DTC): C1411. It is for the HYDRAULIC UNIT ASSEMBLY",
    "The following DTCs P2721 and P2763 are set by the TCM! Reprogramming files for the {}, version 2, are out",
    "SYMPTOM 1: A {} buzz SYPMTOM 2: A grinding sound NOTE: Tighten the {} bolts.",
    "SYMPTOM 1: Smell of {} NOTE: ventilate",
    "The {} may not respond when the key is turned. Availability of the new {} developed to address this is announced.",
    "The auto hold function that activates in response to a fault detected, was adjusted for {}",
    "The affected {} cars may stall. This is a matter of fuel. Install a {} filter.",
    "Technical service bulletin: {} trim",
    "Software update for {}",
    "{} improvement - Update the {} software on certain cars. Do not replace the {} unit.",
    "This bulletin provides instructions on how to remedy a {} fault lamp. Torque the bolts",
    "This bulletin provides the procedure to replace the {} when the {} makes noise! Ok.",
    "",
    "Customer satisfaction letter about {}",
    "“Customers may experience the following: • {} vibration” was seen. Calibrate the {}",
    "Inspect the {} in winter",
)
_NAMES = ("fuel pump", "RADIO", "door latch", "A/C compressor", "12V battery")
_FILLED = "CASE doc_id % {} {} END".format(len(SUMMARIES), " ".join(f"WHEN {k} THEN {_text(t)}" for k, t in enumerate(SUMMARIES)))
_NAME = "CASE CAST(floor(doc_id / 25) AS BIGINT) % 5 " + " ".join(f"WHEN {k} THEN {_text(n)}" for k, n in enumerate(_NAMES)) + " END"
_KIND = "CASE doc_id % 11 WHEN 3 THEN 'Warranty  program/extension' WHEN 7 THEN 'Owner Letter' ELSE 'Service Bulletin/Repair Instructions' END"
_RECORDS = f"SELECT doc_id AS id, {_KIND} AS kind, CASE WHEN doc_id % 31 = 5 THEN NULL ELSE replace({_FILLED}, '{{}}', {_NAME}) END AS summary FROM documents"


# ---- the extraction in SQL


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_text('(?i)' + pattern)})"


def _sub(x: str, pattern: str, to: str = "", every: bool = False) -> str:
    return f"regexp_replace({x}, {_text('(?i)' + pattern)}, {_text(to)}{', ' + _text('g') if every else ''})"


def _said(x: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, {_text('(?i)' + p)}, 1)), '')" for p in patterns) + ", '')"


def _led(x: str, leads=X.TEXT_LEADS) -> str:
    for lead in leads:
        x = _sub(x, lead)
    return f"trim({x})"


def _concern(x: str) -> str:
    x = _sub(_sub(_led(x), X.FILLERS, every=True), "[‘’]", every=True)
    return _sub(f"trim({_sub(x, ' +', ' ', True)})", r" +\.$", ".")


def _sentence(x: str) -> str:
    return f"list_transform([{_led('trim(' + _sub(x, f'^[{X.QUOTES}]+|[{X.QUOTES}]+$', every=True) + ')')}], lambda z: upper(z[1]) || z[2:])[1]"


def _ended(x: str) -> str:
    return f"CASE WHEN {x} = '' OR regexp_matches({x}, '[.!?]$') THEN {x} ELSE {x} || '.' END"


def _codes(x: str) -> str:
    return f"list_transform(list_transform([regexp_extract_all({x}, '(?i)\\b[PBCU][0-9A-F]{{4}}\\b')], lambda c: list_transform(c, lambda y: upper(y))), lambda l: list_filter(l, lambda y, i: list_position(l, y) = i))[1]"


def _phrase(c: str) -> str:
    return f"CASE len({c}) WHEN 0 THEN NULL WHEN 1 THEN 'DTC ' || {c}[1] WHEN 2 THEN 'DTCs ' || {c}[1] || ' and ' || {c}[2] ELSE 'DTCs ' || array_to_string({c}[:-2], ', ') || ', and ' || {c}[-1] END"


def _unless_empty(x: str, then: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {then} END"


def _parts_sql(records: str) -> str:
    body = "b.body"
    raw = {
        "told": _said(body, *X.TOLD), "failure": _said(body, X.FAILURE), "related": _concern(_said(body, *X.RELATED)), "s1": _concern(_said(body, X.NUMBERED[0])), "s2": _concern(_said(body, X.NUMBERED[1])),
        "unanswered": _concern(_said(body, X.UNANSWERED)), "activated": _concern(_said(body, *X.ACTIVATED)), "lamp_codes": _codes(_said(body, X.LAMP_REST)), "set_codes": _codes(_said(body, *X.CODED)), "obd_codes": _codes("b.title || ' ' || b.body"),
        **{f"k{i}": _concern(_said(body, *p)) for i, (p, _) in enumerate(X.CONCERNS)},
        "complaint": f"coalesce(list_filter(b.sentences, lambda s: regexp_matches(s, {_text(_join(gates.SYMPTOM))}))[1], '')", "first": "coalesce(b.sentences[1], '')",
        "remedy": "coalesce(" + ", ".join(f"nullif({_said(body, r)}, '')" for r in X.REMEDY) + f", list_filter(b.sentences, lambda s: {_has('s', X.MAIN_ACTION)})[1], list_filter(b.sentences, lambda s: regexp_matches(s, {_text(_join(gates.ACTION))}))[1], '')",
    }
    plain = "complaint"
    for pattern, to in X.SENTENCE_LEADS:
        plain = _sub(plain, pattern, to)
    activated = "activated"
    for pattern, to in X.ACTIVATED_AS:
        activated = _sub(activated, pattern, to)
    activated = f"regexp_replace({activated}, ' +', ' ', 'g')"
    rest = "remedy"
    for lead in X.REMEDY_LEADS:
        rest = _sub(rest, lead)
    about = [_unless_empty("failure", f"regexp_replace({_sentence('failure')} || ' failure' || CASE WHEN related <> '' THEN ' causing ' || related ELSE '' END || '.', '[.][.]', '.')")]
    about += [_unless_empty(f"k{i}", _sentence(_sub(f"k{i}", lead) if lead else f"k{i}") + " || '.'") for i, (_, lead) in enumerate(X.CONCERNS)]
    about += [
        f"CASE WHEN {_has('body', X.LAMP)} THEN 'SES light on with ' || {_phrase('lamp_codes')} || '.' END",
        f"{_phrase('set_codes')} || ' detected' || CASE WHEN {_has('body', X.MODULES[0][0])} THEN '{X.MODULES[0][1]}' WHEN {_has('body', X.MODULES[1][0])} THEN '{X.MODULES[1][1]}' ELSE '' END || '.'",
        f"CASE WHEN s1 <> '' AND s2 <> '' THEN {_sentence(_sub('s1', '[.]$'))} || ' or ' || regexp_replace(regexp_replace(s2, '[.]$', ''), '^A +', 'a ') || '.' WHEN s1 <> '' THEN {_sentence('s1')} || '.' END",
        _unless_empty("unanswered", "'System does not respond when ' || unanswered || '.'"),
        _unless_empty("activated", _sentence(activated)),
        f"CASE WHEN complaint <> '' AND NOT regexp_matches({_sentence(plain)}, {_text(_join(gates.ACTION_FIRST))}) THEN {_sentence(plain)} END",
        f"CASE WHEN NOT {_has('title', X.NO_CONCERN)} THEN {_sentence('title')} END",
    ]
    fix = []
    for patterns, before, after, software in X.REMEDIES:
        target = _said("remedy", *patterns)
        begin = _text(before) if software is None else f"CASE WHEN {_has(target, 'software')} THEN {_text(software)} ELSE {_text(before)} END"
        fix.append(_unless_empty(target, f"{begin} || {target} || {_text(after)}"))
    fix += [f"CASE WHEN {_has('remedy', X.FILES)} AND {_has('remedy', p)} THEN 'Reprogram the {n}.' END" for n, p in X.FILE_TARGETS]
    fix += [_unless_empty(_said("remedy", X.INSPECTED), f"'Inspect ' || {_said('remedy', X.INSPECTED)} || '.'"), f"trim({_ended('(' + rest + ')')})"]
    title = _led("t[:strpos(t || ' - ', ' - ') - 1]", tuple(rf"^{lead}:\s*" for lead in X.TITLE_LEADS))
    return f"""c AS (SELECT *, trim(regexp_replace(coalesce(summary, ''), '\\s+', ' ', 'g')) AS t FROM ({records})),
    a AS (SELECT *, {title} AS title, CASE WHEN contains(t, ' - ') THEN trim(t[strpos(t, ' - ') + 3:]) ELSE t END AS body FROM c),
    b AS (SELECT *, list_filter(string_split(regexp_replace(body, '([.!?])\\s+', '\\1§', 'g'), '§'), lambda s: s <> '') AS sentences FROM a),
    r AS (SELECT b.*, {", ".join(f"{x} AS {n}" for n, x in raw.items())} FROM b),
    p AS (SELECT *, coalesce({_unless_empty('told', 'nullif(list_transform([' + _sentence('told') + '], lambda z: ' + _ended('z') + ")[1], '')")}, nullif(coalesce({", ".join(about)}, ''), ''), nullif(complaint, ''), nullif(title, ''), nullif(first, ''), body) AS description,
     CASE WHEN remedy = '' OR {_has('remedy', X.NO_REMEDY)} THEN '' ELSE coalesce({", ".join(fix)}) END AS resolution FROM r)"""


@query(f"WITH {_parts_sql(_RECORDS)} SELECT id, title, body, description, resolution, array_to_string(obd_codes, ',') AS codes FROM p")
def bulletin_parts(spark, d):
    part = X.seed_parts(F.col("summary"), gates.either(gates.SYMPTOM), gates.either(gates.ACTION), gates.either(gates.ACTION_FIRST))
    rows = rows_of(spark, d, _RECORDS).select("id", part.alias("p"))
    return rows.select("id", *(F.col(f"p.{c}").alias(c) for c in ("title", "body", "description", "resolution")), F.array_join("p.obd_codes", ",").alias("codes"))


@query(
    f"""WITH {_parts_sql(_RECORDS)}, w AS (SELECT *, lower(trim(regexp_replace(kind, '\\s+', ' ', 'g'))) AS k, trim(regexp_replace(kind || ' ' || coalesce(summary, ''), '\\s+', ' ', 'g')) AS w FROM p),
    s AS (SELECT *, regexp_matches(w, {_text(_join(gates.ACTION))}) AS acts, regexp_matches(w, {_text(_join(gates.SYMPTOM))}) OR len(obd_codes) > 0 AS shows FROM w)
    SELECT id, CASE WHEN k NOT IN ('{gates.SERVICE}', '{gates.WARRANTY}') THEN 'communication_type' WHEN regexp_matches(w, {_text(_join(gates.NOTICE))}) THEN 'notice' WHEN NOT acts AND NOT shows THEN 'no_symptom_no_action' WHEN length(description) < 12 THEN 'thin_description' WHEN regexp_matches(w, {_text(_join(gates.PREVENTIVE))}) THEN 'preventive'
     WHEN regexp_matches(description, {_text(_join(gates.ACTION_FIRST))}) OR lower(description) = lower(resolution) THEN 'not_separated' WHEN length(resolution) < 10 OR regexp_matches(resolution, {_text(_join(gates.VAGUE_FIX))}) OR NOT regexp_matches(resolution, {_text(_join(gates.ACTION))}) THEN 'weak_resolution'
     WHEN NOT (regexp_matches(w, {_text(_join(gates.CONCRETE))}) OR len(obd_codes) > 0) THEN 'not_concrete' WHEN k = '{gates.SERVICE}' AND acts AND shows THEN 'complete' ELSE 'not_strong' END AS reason FROM s"""
)
def bulletin_chain(spark, d):
    return gates.classified_bulletins(rows_of(spark, d, _RECORDS).withColumn("make", F.lit("Ford"))).select("id", "reason")


# ---- symptom tags

SYMPTOMS = (
    'The display shows "service soon please now ok"', "“Radio message not available today”", "• Door glass on the left won’t drop", "The fuel-filler lid does not lock", "Power liftgate doesn't, it does not close", "power liftgate won't open", "TBM: the backup battery is low", "The 12-volt main battery is flat", "ITM stuck",
    "Battery monitor module reset", "active grille air shutter jammed", "Can't shift out of park", "Torque converter damper clutch does not engage", "carbon fouling makes it misfire", "Seat warmer does not operate", "The window won’t open", "DTCs P0301, p0302-13 and U0100/1 stored", "Uconnect box requires service", "MIL illumination", "A warning light", "BSM off",
    "Right taillight dim", "Rear seat is not quite locked", "Door handle is loose", "Harsh downshift at low speed", "clicking noise inside", "HVAC makes a noise", "Fuel door will not open", "It won't start", "parasitic drain overnight", "musty odor", "The horn relay switch is inoperative in winter", "Customer states that she sees an odd message displayed on screen", "Code C1411 found",
    "Vehicle exhibits a shudder when braking", "rough idle, due to air", "", "Some cars vibrate", "Grinding at the front axle all day long.",
)
_ONE = "CASE {} % {} {} END".format("{}", len(SYMPTOMS), " ".join(f"WHEN {k} THEN {_text(s)}" for k, s in enumerate(SYMPTOMS)))
_SHOWN = f"SELECT doc_id AS id, {_ONE.format('doc_id')} AS s1, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {_ONE.format('(doc_id * 7 + 3)')} END AS s2, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE {_ONE.format('(doc_id * 5 + 1)')} END AS about, {_ONE.format('(doc_id * 11 + 2)')} AS summary, CASE WHEN doc_id % 4 = 1 THEN 'P0301' END AS code FROM documents"


def _words(x: str, most: int = X.MOST_WORDS) -> str:
    return f"array_to_string(list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')[:{most}], ' ')"


def _tag(x: str) -> str:
    """The tag of a text in SQL."""
    holds = lambda rules: " ".join(f"WHEN {' AND '.join(_has('t', p) for p in patterns)} THEN {_text(name)}" for name, patterns in rules)

    def cut(rules) -> str:
        y = "t"
        for pattern, to in rules:
            y = _sub(y, pattern, to)
        return y

    quote = _said("t", X.QUOTED)
    codes = f"list_transform([list_transform(regexp_extract_all(t, {_text('(?i)' + X.LONG_CODE)}, 1), lambda y: upper(y))], lambda l: list_filter(l, lambda y, i: list_position(l, y) = i))[1]"
    code = f"CASE WHEN len({codes}) = 1 THEN 'DTC ' || {codes}[1] WHEN len({codes}) > 1 THEN 'DTCs ' || array_to_string({codes}[:4], '/') END"
    quoted = f"CASE WHEN {_has(quote, 'not available')} THEN {_words(_sub(quote, 'message', every=True), 3)} ELSE {_words(quote)} END"
    tag = f"coalesce(nullif({quoted}, ''), CASE {holds(X.TAGS_FIRST)} END, CASE WHEN {_has('t', X.CODE_FIRST)} THEN {code} END, CASE {holds(X.TAGS_NEXT)} WHEN {_has('t', 'inoperative')} THEN {_words(cut(X.DEAD), 3)} WHEN {_has('t', 'message')} THEN {_words(cut(X.SHOWN))} END, {code}, {_words(cut(X.CIRCUMSTANCES))})"
    lead = "'^[•\\-–\\s]+'"
    return f"list_transform([trim(regexp_replace(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')), {lead}, ''))], lambda t: {tag})[1]"


_distinct = "list_transform([{}], lambda l: list_filter(l, lambda y, i: list_position(l, y) = i))[1]".format
_fit = lambda l: f"list_filter({l}, lambda g: g <> '' AND len(string_split(g, ' ')) <= 4 AND NOT {_has('g', X.RAW)})"
_special = f"list_filter({{}}, lambda g: g NOT IN ('{X.GENERIC_TAGS[0]}', '{X.GENERIC_TAGS[1]}'))".format
_not_code = lambda l: f"list_filter({l}, lambda g: NOT {_has('g', X.CODE_TAG)})"


@query(
    f"""WITH t AS (SELECT *, {_tag("s1")} AS t1, CASE WHEN s2 IS NOT NULL THEN {_tag("s2")} END AS t2, {_tag("about")} AS ta, {_tag("summary")} AS ts FROM ({_SHOWN})),
    g AS (SELECT *, {_distinct(_fit("list_filter([t1, t2], lambda g: g IS NOT NULL)"))} AS g1, {_distinct(_fit("[ta, ts]"))} AS g2, list_filter([ta], lambda g: g <> '') AS ga FROM t),
    f AS (SELECT *, CASE WHEN len(g1) > 0 THEN g1 ELSE ga END AS tags, CASE WHEN len(g2) > 0 THEN g2 ELSE ga END AS derived FROM g)
    SELECT id, array_to_string(tags, '|') AS tags, array_to_string(CASE WHEN len({_special("tags")}) > 0 THEN {_special("tags")} WHEN len({_special("derived")}) > 0 THEN {_special("derived")} ELSE tags END, '|') AS specific,
     array_to_string(CASE WHEN len(tags) > 0 AND len({_not_code("tags")}) = 0 THEN {_distinct(f"list_concat({_special(_not_code('derived'))}, tags)")} ELSE tags END, '|') AS beside, array_to_string(CASE WHEN code IS NULL THEN tags ELSE {_not_code("tags")} END, '|') AS uncoded FROM f"""
)
def symptom_tags(spark, d):
    c = F.col
    some = F.filter(F.array("s1", "s2"), lambda s: s.isNotNull())
    codes = F.filter(F.array("code"), lambda s: s.isNotNull())
    rows = rows_of(spark, d, _SHOWN).withColumn("tags", X.symptom_tags(some, c("about")))
    out = {"tags": c("tags"), "specific": X.without_generic(c("tags"), c("about"), c("summary")), "beside": X.beside_codes(c("tags"), c("about"), c("summary")), "uncoded": X.without_codes(c("tags"), codes)}
    return rows.select("id", *(F.array_join(v, "|").alias(n) for n, v in out.items()))


# ---- engine technology and its codes

_ENGINES = ("110 kW - 2.0 TDI AdBlue", "1.4 TSI", "Dual Motor", "Plug-In Hybrid 1.5 TSI", "2.2d", "6.7 Cummins DEF", "1.6", "N47 2.0d", "SCR", "E-TECH", "Mach-E Electric")
_CARS = f"SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Tesla' WHEN 1 THEN 'Seat' ELSE 'Audi' END AS brand, CASE p_partkey % 13 {' '.join(f'WHEN {k} THEN {_text(e)}' for k, e in enumerate(_ENGINES))} END AS engine_power FROM part"
_LISTS = "SELECT 'engine' AS level, CASE p_size % 5 WHEN 0 THEN 'diesel' WHEN 1 THEN 'turbo' WHEN 2 THEN 'electric' WHEN 3 THEN 'hybrid' ELSE 'adblue' END AS name, concat('P', CAST(1000 + p_partkey % 40 AS STRING)) AS code FROM part UNION SELECT 'brand' AS level, CASE WHEN p_size % 2 = 0 THEN 'Audi' ELSE 'Volkswagen' END AS name, concat('P', CAST(1020 + p_partkey % 30 AS STRING)) AS code FROM part UNION SELECT 'common' AS level, '' AS name, concat('P', CAST(1000 + p_partkey % 7 AS STRING)) AS code FROM part"


@query(
    f"""WITH c AS (SELECT id, CASE brand WHEN 'Seat' THEN 'Volkswagen' ELSE brand END AS brand, CASE WHEN brand = 'Tesla' THEN ['electric'] ELSE list_filter([{", ".join(f"CASE WHEN regexp_matches(coalesce(engine_power, ''), {_text('(?i)' + p)}) THEN '{n}' END" for n, p in V.ENGINE_TECH.items())}], lambda t: t IS NOT NULL) END AS tech, coalesce(engine_power, '') AS power FROM ({_CARS})),
    x AS (SELECT *, CASE WHEN list_contains(tech, 'diesel') AND regexp_matches(power, {_text("(?i)" + V.UREA)}) THEN list_append(tech, 'adblue') ELSE tech END AS tags FROM c), l AS ({_LISTS}), k AS (SELECT code FROM l WHERE level = 'common'),
    h AS (SELECT DISTINCT id, level, code FROM (SELECT id, 'common' AS level, code FROM x, k UNION ALL SELECT id, 'engine', code FROM (SELECT id, unnest(tags) AS tag FROM x) JOIN l ON level = 'engine' AND name = tag WHERE code NOT IN (SELECT code FROM k) UNION ALL SELECT id, 'brand', code FROM x JOIN l ON level = 'brand' AND name = brand))
    SELECT x.id, array_to_string(tags, ',') AS tags, count(*) FILTER (level = 'common') AS common, count(*) FILTER (level = 'engine') AS engine, count(*) FILTER (level = 'brand') AS brand_codes, coalesce(max(code) FILTER (level = 'engine'), '') AS last_engine FROM x LEFT JOIN h ON x.id = h.id GROUP BY ALL"""
)
def engine_codes(spark, d):
    cars = rows_of(spark, d, _CARS).withColumn("tags", V.engine_tech(F.col("brand"), F.col("engine_power")))
    met = faults.codes_of_cars(cars, rows_of(spark, d, _LISTS))
    last = F.coalesce(F.array_max("engine"), F.lit(""))
    return met.select("id", F.array_join("tags", ",").alias("tags"), *(F.size(c).cast("long").alias(n) for n, c in (("common", "common"), ("engine", "engine"), ("brand_codes", "brand_codes"))), last.alias("last_engine"))
