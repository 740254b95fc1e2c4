"""The retrieval score: how well a stored case answers a question, both ways.

Sums run over the input's arrays in their order, as doubles: the order of additions is part of the
result's meaning when a score meets a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of what can agree, thresholds, and the bonus for confirmation.
MODEL, ENGINE, CODE_GENERIC, CODE_SPECIFIC, SYMPTOM, WORD = 3.0, 2.0, 2.0, 5.0, 1.5, 0.3
MILEAGE_CLOSE, MILEAGE_FAR, TEXT_MOST = 2.0, 1.0, 2.0
SCORE_LEAST, INPUT_SHARE, RATIO_LEAST = 8.0, 0.7, 0.5
CONFIRMED_MOST, CONFIRMED_BONUS = 8, 0.12
SPACE = r"[\s\x0B\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def clean(text: Column) -> Column:
    """White space as single blanks, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def given(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def _some(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def code_weight(code: Column) -> Column:
    return F.when(F.upper(code).rlike("^P[02]"), CODE_GENERIC).otherwise(CODE_SPECIFIC)


def leading_int(text: Column) -> Column:
    """The number a text starts with, as a lenient parser reads it; null if there is none."""
    return F.regexp_extract(text.cast("string"), rf"^{SPACE}*([+-]?[0-9]{{1,18}})", 1).try_cast("long")


def mileage_score(a: Column, b: Column) -> Column:
    a, b = leading_int(a), leading_int(b)
    ratio = F.least(a, b) / F.greatest(a, b)
    return F.when((a > 0) & (b > 0), F.when(ratio >= 0.7, MILEAGE_CLOSE).when(ratio >= 0.5, MILEAGE_FAR).otherwise(0.0)).otherwise(F.lit(0.0))


def long_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: F.length(w) > 4)


def most_score(model: Column, engine: Column, mileage: Column, codes: Column, symptoms: Column, text: Column) -> Column:
    """The score of perfect agreement with one side."""
    start = F.when(given(model), MODEL).otherwise(0.0) + F.when(given(engine), ENGINE).otherwise(0.0)
    start = start + F.when(given(mileage.cast("string")) & (mileage.cast("string") != "0"), MILEAGE_CLOSE).otherwise(0.0)
    with_codes = F.aggregate(_some(codes), start, lambda s, c: s + code_weight(c))
    return with_codes + F.size(_some(symptoms)) * F.lit(SYMPTOM) + F.least(F.size(long_words(text)) * F.lit(WORD), F.lit(TEXT_MOST))


def agreement(q: dict[str, Column], c: dict[str, Column]) -> Column:
    """The score of case `c` for question `q` (model, engine, mileage, codes, symptoms, text)."""
    everything = F.lower(F.concat_ws(" ", _some(c["symptoms"]), _some(c["codes"]), F.coalesce(c["text"], F.lit(""))))
    start = F.when(given(q["model"]) & (q["model"] == c["model"]), MODEL).otherwise(0.0) + F.when(given(q["engine"]) & (q["engine"] == c["engine"]), ENGINE).otherwise(0.0)
    start = start + mileage_score(q["mileage"], c["mileage"])
    has = lambda part: F.contains(everything, F.lower(part))
    codes = F.aggregate(_some(q["codes"]), start, lambda s, x: s + F.when(has(x), code_weight(x)).otherwise(0.0))
    symptoms = F.aggregate(_some(q["symptoms"]), codes, lambda s, x: s + F.when(has(x), SYMPTOM).otherwise(0.0))
    words = F.aggregate(long_words(q["text"]), F.lit(0.0), lambda s, w: F.when(has(w), F.least(s + WORD, F.lit(TEXT_MOST))).otherwise(s))
    return symptoms + words


def f1(score: Column, most_asked: Column, most_held: Column) -> Column:
    """Harmonic mean of the shares of both sides that agree."""
    ahead = F.when(most_asked > 0, score / most_asked).otherwise(0.0)
    back = F.when(most_held > 0, score / most_held).otherwise(0.0)
    return F.when(ahead + back == 0, 0.0).otherwise(2 * ahead * back / (ahead + back))


def passes(score: Column, ratio: Column, most_asked: Column) -> Column:
    return (score >= F.least(F.lit(SCORE_LEAST), most_asked * INPUT_SHARE)) & (ratio >= RATIO_LEAST)


def confirmation_bonus(n: Column) -> Column:
    held = F.least(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)), F.lit(CONFIRMED_MOST))
    return 1 + (held - 1) / F.lit(CONFIRMED_MOST - 1) * CONFIRMED_BONUS


def strength(ratio: Column, score: Column) -> Column:
    """high, mid or partial; rows without a ratio go by their score."""
    by_score = F.when(score >= 8, "high").when(score >= 5, "mid").otherwise("partial")
    return F.when(ratio.isNull(), by_score).when(ratio >= 0.72, "high").when(ratio >= 0.58, "mid").otherwise("partial")


#: How bulletin prose begins, and what its body holds.
PROSE_START = r"(?i)^(?:some|certain|various|affected|these|the following|vehicles listed|for vehicles listed)\b"
PROSE_BODY = r"(?i)\b(?:equipped with|built on|produced from|through|model statement above|this bulletin provides|this service bulletin provides|\d{4}(?:[-–]\d{4}|my))\b"
BULLETIN_HOST = "static.nhtsa.gov/odi/tsbs/"


def bulletin_prose(text: Column) -> Column:
    plain = clean(text)
    return ((F.length(plain) >= 135) & plain.rlike(PROSE_START)) | ((F.length(plain) >= 160) & plain.rlike(PROSE_BODY))


def suppressed(thread_url: Column, description: Column, symptoms: Column) -> Column:
    """Bulletin rows whose description or any symptom is prose rather than a complaint."""
    prose = bulletin_prose(description) | F.exists(_some(symptoms), bulletin_prose)
    return F.coalesce(F.contains(thread_url, F.lit(BULLETIN_HOST)), F.lit(False)) & prose


def canonical_key(source_ref: Column, brand: Column, model: Column, codes: Column, description: Column, resolution: Column) -> Column:
    """What makes two rows the same case to a reader."""
    plain = lambda c: F.lower(clean(c))
    listed = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(_some(codes), lambda x: F.upper(clean(x))), lambda x: x != ""))), ",")
    return F.concat_ws("||", plain(source_ref), plain(brand), plain(model), listed, plain(description), plain(resolution))


def fault_key(fault: Column) -> Column:
    return F.when(given(fault) & (fault != "other"), fault)
