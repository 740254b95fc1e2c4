"""Operator 7, PII [native]: surrogates instead of personal data.

Built-in functions only.  Entities are e-mail addresses, payment-card, phone, social-security and
bank-account numbers, IPv4 and IPv6 addresses, names behind a form of address, and, in the same text,
the parts of such a name wherever they stand by themselves.  An entity consists of *units*, a kind and
a canonical form: the digits of a number whatever its separators, the lower-case address, each part
of a name.  Equal units get equal surrogates everywhere, so who is meant in two places stays the same
(coreference).

1. One pass of the patterns over each text puts a marker around its entities; texts are cut there once
   and the pieces of those that have any are kept as a table.  The marker holds a hash of the text, so
   that no text has it.  Patterns begin at a word's edge and have bounded parts: time grows in
   proportion to a text, whatever it holds.
2. Units are made distinct (partial aggregation first), and each gets a surrogate drawn from the SHA-256
   of key, unit and attempt: digits for digits in a number of the same length and shape, letters for
   letters of the same case and script, given names by the gender of the form of address, in Latin or
   Cyrillic; a card that passes the Luhn test, and an account number with right check digits in its
   country, get one that does.
3. Collision check: a surrogate that equals another's, or any original of its kind, is drawn again
   with the next attempt, the holder of the least original keeping it, until none is left.  Later
   attempts lengthen the surrogate, so this ends even where a kind's space is full.
4. The surrogates go back to each text that has entities, in the entity's own spelling: separators,
   case and surroundings stay.

Surrogates can be linked to originals only with the key: whoever calls this keeps it secret.

Edge cases: null texts stay null; texts without entities stay byte for byte; equal texts get equal
results; null or repeated doc_ids are carried through; a table without entities, or empty, is
returned as it is; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

LENGTHEN = 6  # attempts after which a surrogate may grow

#: Forms of address by gender, and the names surrogates are made of.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Госпожа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин")
OTHER_TITLES = ("Dr", "Prof")
GIVEN = {
    "f": ("Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Vera"),
    "m": ("Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul"),
    "n": ("Alex", "Andrea", "Charlie", "Kim", "Luca", "Mika", "Nicola", "Robin", "Sam", "Sasha", "Toni", "Val"),
    "cf": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    "cm": ("Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Олег", "Павел"),
    "cn": ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Тоня", "Миша"),
}
SYLLABLES = ("ba", "den", "fal", "gor", "hin", "jas", "kel", "lor", "man", "nes", "pol", "ris", "sol", "tar", "vin", "wer")
CYRILLIC = ("ба", "ден", "фал", "гор", "лин", "яс", "кел", "лор", "ман", "нес", "пол", "рис", "сол", "тар", "вин", "зер")

NOT_BEFORE, NOT_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
NAME_PART = r"\p{Lu}[\p{L}’'-]{1,40}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?:{OCTET}\.){{3}}{OCTET}(?!\.?[\p{{L}}\p{{N}}])"
HEX = "[0-9A-Fa-f]{1,4}"
#: The usual shapes, each with one separator throughout; tried first, so that a number beside a card stays its own.
CARD = "|".join(["[0-9]{13,19}", *(f"[0-9]{{4}}(?:{s}[0-9]{{4}}){{3}}(?:{s}[0-9]{{3}}(?![0-9]))?|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{4,5}}|[0-9]{{6}}{s}[0-9]{{13}}" for s in (r"\x20", "-"))])
#: 16 digits or more behind the plus, spelled out as lookbehinds need it.
TOO_LONG = r"\+" + r"[\x20.()-]{0,2}[0-9]" * 16 + r"[\x20.()-]{0,2}[0-9]?" * 3
#: By what they begin with; all but the last begin at a word's edge.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,63}",
    "name": rf"(?:{TITLES})\.?\x20{NAME_PART}(?:\x20{NAME_PART}){{0,2}}",
    "iban": rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?{NOT_AFTER}",
    "ip": rf"(?<!\.){IP}",
    "ip6": rf"(?<!:)(?:(?:{HEX}:){{7}}{HEX}|(?=[0-9A-Fa-f:]{{0,40}}[0-9])(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "ssn": rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\p{{L}}\p{{N}}-])",
    "card": rf"(?:{CARD}|(?![0-9]{{1,4}}[\x20-](?:{CARD}){NOT_AFTER})[0-9](?:[\x20-]?[0-9]){{12,18}}){NOT_AFTER}",
    "local": rf"(?:[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}|[2-9][0-9]{{2}}\x20[0-9]{{3}}\x20[0-9]{{4}}|0[0-9]{{1,4}}[\x20/][0-9]{{5,8}}){NOT_AFTER}",
    "phone": rf"(?:\+1[\x20.-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[\x20.-]?[0-9]{{3}}[\x20.-]?[0-9]{{4}}{NOT_AFTER}|\+[0-9]{{1,3}}[\x20.-]?(?:\([0-9]{{1,4}}\)[\x20.-]?)?[0-9]{{2,4}}(?:[\x20.-]?(?!{IP})[0-9]{{2,4}}){{1,3}}(?<!{TOO_LONG})|\([0-9]{{3}}\)\x20?[0-9]{{3}}[.-][0-9]{{4}}){NOT_AFTER}",
}
_of = lambda *kinds: "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
ANY = rf"{NOT_BEFORE}(?:{_of('email')}|(?=\p{{Lu}})(?:{_of('name', 'iban')})|(?=[0-9])(?:{_of('ip', 'ssn', 'card', 'local')})|(?=[0-9A-Fa-f]{{1,4}}:)(?:{_of('ip6')}))|(?=[+(])(?:{PATTERNS['phone']})"
#: A cheap test that most texts without entities fail, most places by their first character.
HINT = rf"(?=[@0-9:{''.join(sorted({t[0] for t in TITLES.split('|')}))}])(?:@|[0-9].?[0-9].?[0-9]|:[0-9A-Fa-f]{{0,4}}:|(?:{TITLES})\.?\x20)"
NUMBERS = ("iban", "ssn", "card", "local", "phone")
JOIN = "\x1f"


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the entity has whole; null for a name's part by itself."""
    first = F
    for kind in PATTERNS:
        # lookarounds see only the entity itself here, which they were true around
        first = first.when(entity.rlike(rf"\A(?:{PATTERNS[kind]})\z"), "phone" if kind == "local" else kind)
    return first.otherwise(None)


def _gender(entity: Column) -> Column:
    title = F.regexp_extract(entity, rf"\A({TITLES})", 1)
    gender = F.when(title.isin(*FEMALE_TITLES), "f").when(title.isin(*MALE_TITLES), "m").otherwise("n")
    return F.concat(F.when(entity.rlike(r"\p{IsCyrillic}"), "c").otherwise(""), gender)


def units(entity: Column) -> Column:
    """The units of an entity as an array of kind JOIN canonical form."""
    kind = kind_of(entity)
    parts = F.slice(F.split(entity, r"\x20"), 2, 4)
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "c").otherwise("")
    of_name = F.transform(parts, lambda p, i: F.concat(F.when(i < F.size(parts) - 1, F.concat(F.lit("given"), _gender(entity))).otherwise(F.concat(F.lit("surname"), script)), F.lit(JOIN), F.lower(p)))
    plain = F.when(kind.isin(*NUMBERS), F.regexp_replace(F.upper(entity), r"[^\p{L}0-9]", "")).otherwise(F.lower(entity))
    return F.when(kind == "name", of_name).otherwise(F.array(F.concat(kind, F.lit(JOIN), plain)))


def _digits(seed: Column, start: int) -> Column:
    """18 decimal digits from a hash."""
    return F.lpad(F.pmod(F.xxhash64(seed, F.lit(start)), F.lit(10**18)).cast("string"), 18, "0")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a number without its last digit; with it the whole ends in 0."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda s, x: s + x,
    )


def check_digit(digits: Column) -> Column:
    return ((10 - luhn(digits) % 10) % 10).cast("string")


def mod97(form: Column) -> Column:
    """Remainder of an account number in its order for checking, letters counting as 10 and up."""
    return F.aggregate(F.split(form, ""), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def account(form: Column, drawn: Column) -> Column:
    """The account number of `drawn`'s digits in `form`'s country, with right check digits if `form` has them."""
    country, inner = F.substring(form, 1, 2), F.substr(drawn, F.lit(5))
    right = mod97(F.concat(F.substr(form, F.lit(5)), F.substring(form, 1, 4))) == 1
    check = F.lpad((98 - mod97(F.concat(inner, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(right, check).otherwise(F.substring(drawn, 3, 2)), inner)


def _drawn(unit: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit's canonical form."""
    kind, form = F.split_part(unit, F.lit(JOIN), F.lit(1)), F.split_part(unit, F.lit(JOIN), F.lit(2))
    seed = F.sha2(F.concat_ws(JOIN, F.lit(key), unit, attempt.cast("string")).cast("binary"), 256)
    stream = F.concat(*(_digits(seed, k) for k in range(4)))
    more = F.greatest(attempt - LENGTHEN, F.lit(0))
    pick = lambda c, i, of: F.substring(F.lit(of), F.pmod(F.xxhash64(seed, i, c), F.lit(len(of))).cast("int") + 1, F.lit(1))

    def like(c: Column, i: Column) -> Column:
        """A character of the same sort."""
        return (
            F.when(c.rlike("[0-9]"), F.substring(stream, F.pmod(i, F.lit(72)) + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), pick(c, i, "ABCDEFGHJKLMNPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(c, i, "абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"\p{IsGreek}"), pick(c, i, "αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"\p{L}"), pick(c, i, "abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )

    changed = lambda text: F.array_join(F.transform(F.split(text, ""), like), "")
    tail = F.substring(_digits(seed, 9), F.lit(1), F.least(more, F.lit(9)))  # empty at first
    ip = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda k: F.pmod(F.xxhash64(seed, k), F.lit(256)).cast("string")), ".")
    domain = F.regexp_extract(form, r"(\.\p{L}+)\z", 1)
    email = F.concat(changed(F.split_part(form, F.lit("@"), F.lit(1))), tail, F.lit("@"), changed(F.regexp_replace(F.split_part(form, F.lit("@"), F.lit(2)), r"\.\p{L}+\z", "")), domain)
    syllables = lambda of: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + more), lambda k: F.element_at(F.array(*map(F.lit, of)), F.pmod(F.xxhash64(seed, k), F.lit(len(of))).cast("int") + 1)), "")
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "surname", F.initcap(syllables(SYLLABLES))).when(kind == "surnamec", F.initcap(syllables(CYRILLIC)))
    hexes = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), pick(c, i, "123456789abcdef")).otherwise(c)), "")
    body = F.concat(F.substring(form, 1, 1), F.substr(changed(form), F.lit(2), F.length(form) - 2), tail)
    last = F.when(check_digit(F.left(form, F.length(form) - 1)) == F.right(form, F.lit(1)), check_digit(body)).otherwise(F.substring(_digits(seed, 8), 1, 1))
    out = out.when(kind == "ip6", hexes).when(kind == "card", F.concat(body, last)).when(kind == "iban", account(form, F.concat(changed(form), tail)))
    for group, names in GIVEN.items():
        name = F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(seed), F.lit(len(names))).cast("int") + 1)
        own = syllables(CYRILLIC if group.startswith("c") else SYLLABLES)
        out = out.when(kind == "given" + group, F.when(attempt == 0, name).otherwise(F.concat(name, F.lit("-"), F.initcap(own))))
    return out.otherwise(F.concat(changed(form), tail))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """unit, surrogate for each of the distinct units `found`: no two alike, none an original."""
    found = durable(found)
    state = found.select("unit", F.lit(0).alias("attempt"))
    space = lambda unit: F.regexp_replace(F.split_part(unit, F.lit(JOIN), F.lit(1)), "given.*|surname.*", "name")
    originals = found.select(space(F.col("unit")).alias("space"), F.lower(F.split_part("unit", F.lit(JOIN), F.lit(2))).alias("form")).distinct()
    while True:
        drawn = durable(state.withColumn("surrogate", _drawn(F.col("unit"), F.col("attempt"), key)))
        named = drawn.select("unit", "attempt", "surrogate", space(F.col("unit")).alias("space"), F.lower("surrogate").alias("form"))
        first = named.groupBy("space", "form").agg(F.min(F.struct((-F.col("attempt")).alias("a"), "unit"))["unit"].alias("holder"))
        taken = originals.withColumn("taken", F.lit(True))
        judged = named.join(first, ["space", "form"]).join(taken, ["space", "form"], "left")
        again = durable(judged.where("taken or holder <> unit").select("unit").withColumn("again", F.lit(1)))
        if again.isEmpty():
            return drawn.select("unit", "surrogate")
        state = drawn.join(again, "unit", "left").select("unit", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


def _spelled(entity: Column, forms: Column) -> Column:
    """The surrogate forms of an entity's units in the entity's own spelling."""
    kind = kind_of(entity)
    whole = forms[0]
    # numbers: the surrogate's characters in turn where the entity has letters or digits
    chars = F.split(entity, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    walked = F.aggregate(
        chars,
        start,
        lambda s, c: F.when(c.rlike(r"[\p{L}0-9]"), F.struct(F.concat(s["out"], F.substring(whole, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        ),
        lambda s: F.concat(s["out"], F.substring(whole, s["at"], F.length(whole))),
    )
    email = F.when(F.upper(entity) == entity, F.upper(whole)).otherwise(whole)
    name = F.concat_ws(" ", F.split(entity, r"\x20")[0], F.array_join(forms, " "))
    return F.when(kind.isin(*NUMBERS), walked).when(kind.isin("email", "ip6"), email).when(kind == "name", name).when(kind.isNull(), F.array_join(forms, " ")).otherwise(whole)


def marked(text: Column, pattern: Column, mark: Column) -> Column:
    return F.regexp_replace(text, pattern, F.concat(mark, F.lit("$0"), mark))


def found_in(docs: DataFrame) -> DataFrame:
    """of (the text's hash), cut (its pieces, every second an entity) and units (by entity), once per text with any.

    The patterns run once over each text; a second, made of the names found in a text, runs over the
    pieces between its entities.
    """
    text = F.col("text")
    mark = F.concat(F.lit("\x1e"), F.hex(F.xxhash64(text)), F.lit("\x1e"))
    pieces = F.split(marked(text, F.lit(ANY), mark), mark, -1)
    # a filter on the pieces themselves would be pushed below and make them twice
    some = F.explode(F.filter(F.array(pieces), lambda p: F.size(p) > 1)).alias("cut")
    of = F.sha2(text.cast("binary"), 256).alias("of")
    first = durable(docs.where(text.rlike(HINT)).select(of, mark.alias("mark"), some).groupBy("of").agg(F.first("mark").alias("mark"), F.first("cut").alias("cut")))
    entities = F.array_distinct(F.filter("cut", lambda x, i: i % 2 == 1))
    known = first.select("of", "mark", "cut", F.transform(entities, lambda e: F.struct(e.alias("entity"), units(e).alias("units"))).alias("units"))
    of_names = F.filter("units", lambda u: kind_of(u["entity"]) == "name")
    part = lambda e: F.slice(F.split(e, r"\x20"), 2, 4)
    parts = F.flatten(F.transform(of_names, lambda u: F.zip_with(part(u["entity"]), u["units"], lambda p, n: F.struct(p.alias("part"), n.alias("unit")))))
    known = known.withColumn("parts", parts)
    named = known.where(F.size("parts") > 0)
    alone = F.concat(F.lit(rf"{NOT_BEFORE}(?:"), F.array_join(F.transform(F.array_distinct(F.transform("parts", lambda p: p["part"])), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), "|"), F.lit(rf"){NOT_AFTER}"))
    again = F.split(F.call_function("array_join", F.transform("cut", lambda x, i: F.when(i % 2 == 1, x).otherwise(marked(x, F.col("alone"), F.col("mark")))), F.col("mark")), F.col("mark"), -1)
    unit_of = lambda e: F.filter("parts", lambda p: p["part"] == e)[0]["unit"]
    bare = F.array_except(F.array_distinct(F.filter("cut", lambda x, i: i % 2 == 1)), F.transform("units", lambda u: u["entity"]))
    more = F.transform(bare, lambda e: F.struct(e.alias("entity"), F.array(unit_of(e)).alias("units")))
    carried = named.withColumn("alone", alone).withColumn("cut", again).withColumn("units", F.concat("units", more))
    return durable(known.where(F.size("parts") == 0).select("of", "cut", "units").unionByName(carried.select("of", "cut", "units")))


def replace(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """`docs` with surrogates in `text`, and how many entities were replaced in it as column `count`."""
    found = found_in(docs)
    entities = found.select("of", F.explode("units").alias("u")).select("of", "u.entity", "u.units")
    distinct = durable(entities.groupBy("entity", "units").agg(F.count(F.lit(1)).alias("n")).select("entity", "units"))
    each = distinct.select("entity", "units", F.posexplode("units").alias("pos", "unit"))
    table = surrogates(each.select("unit").distinct(), key)
    forms = each.join(table, "unit").groupBy("entity", "units").agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))).alias("s"))
    spelled = durable(forms.select("entity", "units", _spelled(F.col("entity"), F.col("s.surrogate")).alias("new")))
    new = entities.join(spelled, ["entity", "units"]).groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("new"))
    woven = F.array_join(F.transform("cut", lambda x, i: F.when(i % 2 == 1, F.element_at(F.col("new"), x)).otherwise(x)), "")
    changed = durable(found.join(new, "of").select(F.col("of").alias("changed"), woven.alias("woven"), F.floor(F.size("cut") / 2).cast("long").alias("n")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    # a text without a hint of entities meets nothing: a key of its own spreads it
    of = F.when(F.col("text").rlike(HINT), F.sha2(F.col("text").cast("binary"), 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "text").cast("string"))).alias("of")
    joined = docs.select(whole, of).join(changed, F.col("of") == F.col("changed"), "left")
    columns = [(F.when(F.col("n").isNotNull(), F.col("woven")).otherwise(F.col("whole.text")) if c == "text" else F.col("whole").getField(c)).alias(c) for c in docs.columns]
    return joined.select(*columns, *([F.coalesce("n", F.lit(0)).alias(count)] if count else []))
