"""Service-bulletin records: identifiers, references and gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clean


def base_bulletin(source_ref: Column) -> Column:
    """A bulletin's id without its agency number, revision, version or date."""
    t = F.trim(F.regexp_replace(F.coalesce(source_ref, F.lit("")), r"(?i)\s*/\s*NHTSA\s+\d+\s*$", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)\s+REV\.\s*[A-Z0-9]+$", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)_R\d+$", ""))
    first = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    dated = F.trim(F.regexp_replace(t, r"-\d{4}-\d{2}-\d{2}$", ""))
    return F.coalesce(first(r"(?i)^TJ(\d+)"), first(r"^(\d+)\.\d"), first(r"(?i)^(PIP\d+)[A-Z]$"), dated)


def agency_number(source_ref: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(source_ref, F.lit("")), r"(?i)/\s*NHTSA\s+(\d+)\s*$", 1).try_cast("long"), F.lit(0))


def revision_rank(source_ref: Column) -> Column:
    """A=1, B=2, ... behind REV, else the number behind R, else 0."""
    t = F.upper(clean(source_ref))
    letter = F.regexp_extract(t, r"\bREV\.?\s*([A-Z])\b", 1)
    number = F.regexp_extract(t, r"(?:^|[_\s-])R(\d{1,2})(?:$|[_\s-])", 1)
    return F.when(letter != "", F.ascii(letter) - 64).otherwise(F.coalesce(number.try_cast("int"), F.lit(0)))


def source_ref(tsb_id: Column, agency_id: Column) -> Column:
    agency = F.when(clean(agency_id) != "", F.concat(F.lit("NHTSA "), clean(agency_id)))
    return F.nullif(F.concat_ws(" / ", F.nullif(clean(tsb_id), F.lit("")), agency), F.lit(""))


def bulletin_day(ymd: Column) -> Column:
    """Noon UTC of an eight-digit day; null if malformed."""
    raw = clean(ymd)
    return F.when(raw.rlike(r"^\d{8}$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd")) + F.expr("INTERVAL 12 HOURS"))


def bulletin_url(agency_id: Column, *days: Column) -> Column:
    year = F.coalesce(*(F.when(clean(d).rlike(r"^\d{8}$"), F.substring(clean(d), 1, 4)) for d in days))
    return F.when(clean(agency_id) != "", F.concat(F.lit("https://static.nhtsa.gov/odi/tsbs/"), year, F.lit("/MC-"), clean(agency_id), F.lit("-0001.pdf")))


def content_id(*fields: Column, length: int = 16) -> Column:
    """A row's id from its content: hex of the SHA-256 of an ordered JSON object, nulls kept."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), 1, length)


def comparable(text: Column) -> Column:
    """Upper-case words without marks, market suffix and punctuation."""
    from .model import fold

    t = F.regexp_replace(fold(clean(text)), r"(?i)\(us\)", " ")
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(t, r"[()!/,_-]+", " "), r"\s+", " ")))


#: Fixed value: the span of years a catalog label ends with.
SPAN = r"(?i)\((\d{4})\s*[–-]\s*(\d{4}|present|current|dosud|současnost|soucasnost)\)"
OPEN_END = 9999


def label_base(label: Column) -> Column:
    return F.trim(F.regexp_replace(clean(label), rf"\s*{SPAN}\s*$", ""))


def label_years(label: Column) -> Column:
    """struct<start, end>, null without a span."""
    start = F.regexp_extract(clean(label), SPAN, 1).try_cast("int")
    end = F.regexp_extract(clean(label), SPAN, 2).try_cast("int")
    return F.when(start.isNotNull(), F.struct(start.alias("start"), F.coalesce(end, F.lit(OPEN_END)).alias("end")))


#: Words of things that are no cars, makers that also build motorcycles, their models.
NOT_CARS = r"(?i)\b(?:scooter|moped|motorcycle|motorbike|motocykl|motorka|quad|atv|utv|hgv|lorry|semi-?truck|tractor|bagr|outboard|jet ?ski|snowmobile|forklift)\b"
MOTORCYCLE_MAKERS = ("bmw", "honda", "suzuki", "yamaha", "kawasaki", "ktm", "ducati", "triumph", "aprilia", "harley-davidson", "harley", "husqvarna", "moto guzzi")
MOTORCYCLES = (
    r"\b[rk]\s?1[0-9]{3}[a-z]{0,4}\b",
    r"\br\s?nine\s?t\b",
    r"\bs\s?1000\s?rr?\b",
    r"\bf\s?[6-9][0-9]{2}\s?(?:gs|r|s)?\b",
    r"\bcbr?\s?\d{3,4}\b",
    r"\bgl\s?1[0-9]{3}\b",
    r"\b(?:vfr|crf|nc|africa ?twin)\s?\d*",
    r"\bgsx?-?\s?r?\s?\d{3,4}\b",
    r"\b(?:v-?strom|hayabusa|dl)\s?\d*",
    r"\byzf?-?\s?r?\s?\d{1,4}\b",
    r"\bmt-?\s?\d{2}\b",
    r"\b(?:fz|fjr|tenere|tracer)\s?\d*",
    r"\b(?:ninja|versys|vulcan)\b",
    r"\bzx-?\s?\d{1,4}\b",
    r"\bz\s?[6-9][0-9]{2}\b",
)


def out_of_scope(brand: Column, model: Column, engine: Column) -> Column:
    """Clearly no car: by a word anywhere, or by a motorcycle's model name from such a maker."""
    b, m, e = (F.lower(clean(x)) for x in (brand, model, engine))
    return F.concat_ws(" ", m, e).rlike(NOT_CARS) | (b.isin(*MOTORCYCLE_MAKERS) & (m != "") & m.rlike("|".join(MOTORCYCLES)))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of a family of patterns is in a text: one alternation, one pass."""
    return F.coalesce(text, F.lit("")).rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))
