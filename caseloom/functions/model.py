"""Vehicle-model labels as column expressions: family, generation, year, and mileage bands.

Everything is a built-in expression, so Catalyst folds it for literals, prunes it when unused, and
keeps it inside code generation where the engine can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to, Roman numerals, band edges and names.
MARKED = "áàâäãåčçćďéèêëěíìîïňñóòôöõøřšśťúùûüůýžź"
FOLDED = "aaaaaacccdeeeeeiiiinnoooooorsstuuuuuyzz"
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
BANDS = ("0-100", "100-150", "150-200", "200+", "unknown")
YEAR = "^(19|20)[0-9]{2}$"


def fold(text: Column) -> Column:
    """Lower case without marks on the letters above."""
    return F.translate(F.lower(text), MARKED, FOLDED)


def model_tokens(model: Column) -> Column:
    """Words of a label, without what stands in parentheses."""
    plain = F.regexp_replace(F.regexp_replace(fold(F.coalesce(model, F.lit(""))), r"\(.*?\)", " "), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda t: t != "")


def _marks_generation(token: Column, first: Column) -> Column:
    """Whether a word starts the generation part; the first word is rather a name than a year or code."""
    always = token.isin("fl", "facelift") | token.rlike("^(mk|mark)[0-9ivxl]*$")
    later = token.rlike(rf"{YEAR}|^[ivxl]{{1,4}}$|^[a-z]$|^[a-z]{{1,2}}[0-9]{{1,3}}[a-z]?$|^[0-9]{{1,2}}[a-z]{{1,2}}$")
    return always | (~first & later)


def _split(model: Column, use) -> Column:
    """use(tokens, place of the first generation word or 0) with both computed once."""
    parts = F.transform(
        F.array(model_tokens(model)),
        lambda ts: F.struct(ts.alias("t"), F.array_position(F.transform(ts, lambda t, i: _marks_generation(t, i == 0)), True).cast("int").alias("at")),
    )
    return F.transform(parts, lambda p: use(p["t"], p["at"]))[0]


def model_family(model: Column) -> Column:
    """Words before the generation, repeats in a row once; null if there are none."""

    def use(tokens, at):
        before = F.when(at == 0, tokens).otherwise(F.slice(tokens, 1, F.greatest(at - 1, F.lit(0))))
        once = F.filter(before, lambda t, i: (i == 0) | (t != F.get(before, i - 1)))
        return F.nullif(F.array_join(once, " "), F.lit(""))

    return _split(model, use)


def roman(token: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv)), token)


def model_generation(model: Column) -> Column:
    """The generation in one spelling (2, mk5, n16, h); null for a bare year or a facelift."""

    def use(tokens, at):
        token, after = F.get(tokens, at - 1), F.get(tokens, at)
        rest = F.regexp_replace(token, "^(mk|mark)", "")
        return (
            F.when(at == 0, None)
            .when(token.rlike(YEAR) | token.isin("fl", "facelift"), None)
            .when(token.isin("mk", "mark"), F.concat(F.lit("mk"), roman(after)))
            .when(token.rlike("^(mk|mark)[ivxl]+$"), F.concat(F.lit("mk"), roman(rest)))
            .when(token.rlike("^mark[0-9]+$"), F.concat(F.lit("mk"), rest))
            .when(token.rlike("^[ivxl]{1,4}$"), F.coalesce(roman(token), token))
            .otherwise(token)
        )

    return _split(model, use)


def model_year(model: Column) -> Column:
    """The first year inside parentheses."""
    return F.nullif(F.regexp_extract(F.coalesce(model, F.lit("")), r"\([^0-9)]*((?:19|20)[0-9]{2})", 1), F.lit(""))


def mileage_band(mileage: Column) -> Column:
    return F.when(mileage.isNull() | (mileage <= 0), "unknown").when(mileage < 100_000, "0-100").when(mileage < 150_000, "100-150").when(mileage < 200_000, "150-200").otherwise("200+")


def mileage_band_or_all(mileage: Column) -> Column:
    """The same for a question: no mileage means every band."""
    band = mileage_band(mileage)
    return F.when(band == "unknown", "all").otherwise(band)


def generation_match(asked_gen: Column, asked_year: Column, gen: Column, stored_gen: Column, year: Column) -> Column:
    """exact, unknown or other: a case's generation against the one asked for.

    Years decide only where a generation is missing on one side; a stored generation that is a year
    counts as the case's year.
    """
    have = F.coalesce(gen, stored_gen)
    have_year = F.coalesce(year, F.when(stored_gen.rlike(YEAR), stored_gen))
    return (
        F.when(asked_gen.isNotNull() & (have == asked_gen), "exact")
        .when((asked_gen.isNull() | have.isNull()) & asked_year.isNotNull() & (have_year == asked_year), "exact")
        .when(have.isNull() & have_year.isNull(), "unknown")
        .otherwise("other")
    )
