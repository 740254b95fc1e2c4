"""Text functions as column expressions; the two steps without a built-in are Arrow-batched."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .scoring import SPACE, clean

ELLIPSIS = "..."


def _last(text: Column, mark: str) -> Column:
    """Where `mark` stands last, counted from 0; -1 if nowhere."""
    back = F.locate(mark[::-1], F.reverse(text))
    return F.when(back > 0, F.length(text) - back - len(mark) + 1).otherwise(-1)


def clamp_for_import(value: Column, most: int = 400) -> Column:
    """At most `most` characters: cut at the last sentence, clause or word in the upper two fifths.

    The separators are tried in order, not by position; an ellipsis always follows a cut.
    """
    text = clean(value)
    budget = max(0, most - len(ELLIPSIS))
    least = int(budget * 0.6)
    sample = F.substring(text, 1, budget + 1)
    cut = F
    for mark in (". ", "! ", "? ", "; ", ": ", ", "):
        cut = cut.when(_last(sample, mark) >= least, _last(sample, mark) + 1)
    cut = cut.when(_last(sample, " ") >= least, _last(sample, " ")).otherwise(budget)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(sample, F.lit(1), cut)), F.lit(ELLIPSIS)))


def clamp_for_seed(value: Column, most: int = 400) -> Column:
    """The other clamp: the last of four sentence ends wins, and no ellipsis follows it."""
    text = clean(value)
    sample = F.trim(F.substring(text, 1, most - len(ELLIPSIS)))
    least = max(120, int(most * 0.6))
    sentence = F.greatest(*(_last(sample, m) for m in (". ", "! ", "? ", "; ")))
    word = _last(sample, " ")
    ended = F.trim(F.substring(sample, F.lit(1), sentence + 1))
    broken = F.concat(F.when(word >= least, F.trim(F.substring(sample, F.lit(1), word))).otherwise(sample), F.lit(ELLIPSIS))
    return F.when(F.length(text) <= most, text).when(sentence >= least, ended).otherwise(broken)


def _ascii_words(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def dedupe_key(value: Column) -> Column:
    """First 100 characters of the lower-case ASCII words."""
    return F.substring(_ascii_words(value), 1, 100)


def dedupe_tokens(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_ascii_words(value), " "), lambda t: F.length(t) >= 3))


def overlap(left: Column, right: Column) -> Column:
    """Common tokens over the larger set; 0 where a side is empty."""
    most = F.greatest(F.size(left), F.size(right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / most).otherwise(0.0)


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / both).otherwise(0.0)


def likely_duplicate(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two write-ups (thread_url, source_ref, resolution) are one.

    Verbatim or nearly so from anywhere; moderately alike only from one source.
    """
    same = lambda k: (clean(a[k]) != "") & (clean(a[k]) == clean(b[k]))
    key = dedupe_key(a["resolution"])
    alike = overlap(dedupe_tokens(a["resolution"]), dedupe_tokens(b["resolution"]))
    return ((key != "") & (key == dedupe_key(b["resolution"]))) | (alike >= 0.95) | ((same("thread_url") | same("source_ref")) & (alike >= 0.45))


class _Marks(dict):
    """What `str.translate` makes of characters: marks go."""

    def __missing__(self, char: int) -> int | None:
        self[char] = None if unicodedata.combining(chr(char)) else char
        return self[char]


_marks = _Marks()


def plain_words(text: str | None) -> str:
    """Compatibility-decomposed, without marks, lower-case ASCII words."""
    plain = text or ""
    if not plain.isascii():
        plain = unicodedata.normalize("NFKD", plain).translate(_marks)
    return re.sub("[^a-z0-9]+", " ", plain.lower()).strip()


@F.pandas_udf(StringType())
def fold_words(values: pd.Series) -> pd.Series:
    return values.map(plain_words)


@F.pandas_udf(ArrayType(StringType()))
def fold_each(values: pd.Series) -> pd.Series:
    """Each text of a list by `plain_words`, those that aren't empty, in order."""
    return values.map(lambda v: sorted(w for w in map(plain_words, v) if w) if v is not None else [])


def _unescape_numbers(text: Column) -> Column:
    """Decimal references, then hexadecimal ones; those of no character become nothing.

    Each distinct reference is replaced once, those that give an ampersand last: what they make up
    with the text behind them is no reference of the same kind.
    """

    def one_kind(text: Column, pattern: str, base: int) -> Column:
        def char(ref: Column) -> Column:
            digits = F.ltrim(F.regexp_extract(ref, pattern, 1), F.lit("0"))
            n = F.conv(F.left(digits, F.lit(7)), base, 10).cast("long")
            valid = (F.length(digits) <= 7) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")

        def replaced(t: Column) -> Column:
            refs = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), lambda r: F.struct((char(r) == "&").alias("last"), r.alias("ref"), char(r).alias("char")))
            return F.aggregate(F.array_sort(refs), t, lambda acc, r: F.replace(acc, r["ref"], r["char"]))

        return F.get(F.transform(F.array(text), replaced), F.lit(0))

    return one_kind(one_kind(text, r"&#(\d+);", 10), r"(?i)&#x([0-9a-f]+);", 16)


#: The named references that are resolved, and the tags that end a line.
NAMED = (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"))
LINE_ENDS = "p|div|li|tr|h1|h2|h3|h4|h5|h6"


def html_to_text(page: Column, numeric: bool = True) -> Column:
    """Visible text of HTML; `numeric=False` leaves numeric references as they are."""
    s = F.coalesce(page, F.lit(""))
    for tag in ("script", "style", "noscript"):
        s = F.regexp_replace(s, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    s = F.regexp_replace(s, r"(?i)<(br|hr)\b[^>]*>", "\n")
    s = F.regexp_replace(s, rf"(?i)</({LINE_ENDS})\b[^>]*>", "\n")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    for name, char in NAMED:
        s = F.regexp_replace(s, f"(?i)&{name};", char)
    if numeric:
        s = _unescape_numbers(s)
    s = F.regexp_replace(F.regexp_replace(s, "\r\n", "\n"), "[ \t]+\n", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), "[ \t]{2,}", " ")
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "")


def page_title(page: Column, numeric: bool = True) -> Column:
    """The title without its last part behind a bar, as sites put their name there."""
    raw = F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    parts = F.split(html_to_text(raw, numeric), r"\s*\|\s*")
    return F.trim(F.array_join(F.when(F.size(parts) > 1, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts), " | "))


#: What forum software writes around a post's own text.
NOISE = r"(?iu)^(citace|quote|l[ií]b[ií] se mi|sd[ií]let|odpov[eě]d[eě]t|report|share|like|reply|přidat komentář)$|^(re:|odp:|fw:|fwd:)|^(#\d+|page \d+ of \d+)$"


def noise_line(line: Column) -> Column:
    plain = F.trim(F.coalesce(line, F.lit("")))
    return (plain == "") | plain.rlike(NOISE)


def clean_post(text: Column, least: int = 40) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: ~noise_line(x))
    joined = F.array_join(lines, "\n")
    return F.when(F.length(joined) >= least, joined).otherwise("")


#: Words that say a thread was solved, by language; English always counts.
SOLVED = {
    "cs": ("vyřešeno", "vyrešeno", "vyřešené", "opraveno", "opravené", "spraveno", "pomohlo", "funguje", "hotovo", "vyřešil", "vyřešilo"),
    "sk": ("vyriešené", "opravené", "funguje", "pomohlo", "hotovo"),
    "de": ("gelöst", "erledigt", "behoben", "repariert", "funktioniert", "lösung", "geklärt"),
    "en": ("solved", "fixed", "resolved", "working", "sorted", "repaired", "success"),
    "pl": ("rozwiązane", "naprawione", "działa"),
    "fr": ("résolu", "réparé", "fonctionne"),
    "nl": ("opgelost", "gerepareerd", "werkt"),
}


def resolution_signal(folded_title: Column, language: Column) -> Column:
    """How many solved-words of the language, or English, stand in a title folded by `fold_words`.

    The words are folded alike, so a letter that has no plain form is a gap in both.
    """
    lang = F.lower(F.substring(F.coalesce(language, F.lit("")), 1, 2))
    padded = F.concat(F.lit(" "), F.coalesce(folded_title, F.lit("")), F.lit(" "))
    languages: dict[str, set[str]] = {}
    for name, own in SOLVED.items():
        for word in map(plain_words, own):
            languages.setdefault(word, set()).add(name)
    found = F.lit(0)
    for word, names in languages.items():
        holds = F.contains(padded, F.lit(f" {word} "))
        found = found + (holds if "en" in names else holds & lang.isin(*sorted(names))).cast("int")
    return found


def discard_bucket(reason: Column) -> Column:
    r = F.lower(F.coalesce(reason, F.lit("")))
    has = lambda x: F.contains(r, F.lit(x))
    return (
        F.when(has("too few posts"), "too_few_posts")
        .when(has("classifier rejected"), "classifier_reject")
        .when(has("no cases"), "extractor_empty")
        .when(F.startswith(r, F.lit("transient")) | has("http 4") | has("http 5") | has("timeout"), "transient")
        .otherwise("other")
    )


def failing_condition(note: Column) -> Column:
    n = F.coalesce(note, F.lit(""))
    named = F.regexp_extract(n, "(?i)failed:([a-z_]+)", 1)
    return F.when(named != "", named).when(n.rlike("(?i)pre-gate"), "pre-gate").when(n.rlike("(?i)not valid JSON"), "parse-fail").otherwise("other")


def obd_codes(text: Column) -> Column:
    """Distinct trouble codes in a text, upper case, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b[PBCU][0-9A-F]{4}\b"), F.lit(0)), F.upper))


def obd_shaped(code: Column) -> Column:
    return code.rlike("^[PBCU][0-9][0-9A-F]{3}$")


def salvage_json(text: Column) -> Column:
    """From the first brace to the last: what a parser may make of a chatty answer; null if none."""
    start, stop = F.locate("{", text), _last(text, "}") + 1
    return F.when((start > 0) & (stop > start), F.substring(text, start, stop - start + 1))


def verified_quotes(quotes: Column, source: Column, least: int = 12, most: int = 5) -> Column:
    """Quotes that stand in the source word for word, case and white space aside."""
    hay = F.lower(clean(source))
    return F.slice(F.filter(quotes, lambda q: (F.length(clean(q)) >= least) & F.contains(hay, F.lower(clean(q)))), 1, most)


#: Marks of fuel types in engine names, in the order they are tried.
FUELS = (
    ("hybrid", r"(?i)\b(Hybrid|HEV|MHEV|FHEV|e-HYBRID|PHEV|GTE)\b"),
    ("electric", r"(?i)\b(Electric|BEV|EV|e-tron|ID\.\d)\b"),
    ("diesel", r"(?i)\b(TDI|CDI|HDI|dCi|CDTI|CRDi|D-?4D|EcoBlue|BlueHDi|Skyactiv-D|JTD|JTDM|DDiS|Multijet)\b"),
    ("petrol", r"(?i)\b(TSI|TFSI|FSI|MPI|GDI|T-?GDI|VTEC|VVT-?i|MIVEC|BoosterJet|DuoJet|DualJet|EcoBoost|PureTech|FireFly|Skyactiv-G|DOHC|Valvetronic)\b"),
)


def fuel_type(engine: Column) -> Column:
    """The first fuel with a mark in the text; one pass tells texts without any."""
    found = F.when(~engine.rlike("|".join(f"(?:{p})" for _, p in FUELS)), F.lit(None).cast("string"))
    for fuel, pattern in FUELS:
        found = found.when(engine.rlike(pattern), fuel)
    return found.otherwise(None)


def valid_resolution(text: Column, least: int = 10, most: int = 1000) -> Column:
    """The first complaint about a resolution, null if it is fine."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.size(F.array_distinct(F.filter(F.split(F.lower(t), rf"{SPACE}+"), lambda w: F.length(w) > 2)))
    return F.when(t == "", "empty").when(F.length(t) < least, "too_short").when(F.length(t) > most, "too_long").when(t.rlike(r"(.)\1{6,}"), "repeated_characters").when(words < 2, "too_few_words")


def localized(row_language: Column, wanted: str, own: Column, translations: dict[str, Column]) -> Column:
    """A text in the wanted language, else as it is; empty counts as missing."""
    held = F.nullif(translations[wanted], F.lit("")) if wanted in translations else F.lit(None).cast("string")
    return F.when(row_language == wanted, own).otherwise(F.coalesce(held, own))


def assigned_translations(language: Column, text: Column, translations: dict[str, Column]) -> dict[str, Column]:
    """Translations to store: a text's own language takes the text itself, empty ones are null."""
    return {lang: F.when(language == lang, text).otherwise(F.nullif(t, F.lit(""))) for lang, t in translations.items()}


def comma_list(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def valid_vin(vin: Column) -> Column:
    return F.upper(F.trim(vin)).rlike("^[A-HJ-NPR-Z0-9]{17}$")


def post_time(when: Column) -> Column:
    """Absolute times only: ISO 8601, or Unix seconds or milliseconds; anything else is null."""
    s = F.trim(F.coalesce(when, F.lit("")))
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.try_cast("long"))).when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("long"))).when(s.rlike(iso), s.try_cast("timestamp"))


#: What engines of forum software leave in their pages, in the order they are tried.
SOFTWARE = (
    ("woltlab", ("(?i)woltlab", r"(?i)data-page-identifier=[\"']com\.woltlab", "WCF_PATH", "wbbThreadList", "(?i)class=[\"']messageText", "messageListItem")),
    ("invision", (r"(?i)ips(?:Community|\.?suite)", "(?i)cPost", "(?i)data-role=[\"']commentContent[\"']", "elComment_", "ipsComment")),
    ("xenforo", ("(?i)xenforo", "(?i)class=[\"']message-content", "(?i)data-author=", "(?i)class=[\"']bbWrapper", "(?i)js-post")),
    ("phpbb", ("(?i)phpbb", "(?i)class=[\"']postbody", r"(?i)class=[\"']post\s", r"(?i)id=[\"']p\d+[\"']", r"(?i)viewtopic\.php")),
    ("vbulletin", ("(?i)vbulletin", "(?i)class=[\"']postcontent", r"(?i)id=[\"']post_message_\d+[\"']", r"(?i)showthread\.php", "(?i)class=[\"']bigusername")),
)


def forum_software(page: Column, least: int = 2) -> Column:
    found = F.when(F.length(F.coalesce(page, F.lit(""))) < 100, "generic")
    for name, marks in SOFTWARE:
        found = found.when(sum((page.rlike(m).cast("int") for m in marks), F.lit(0)) >= least, name)
    return found.otherwise("generic")
