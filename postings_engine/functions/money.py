"""Pay parsing: free text to an annual range in GBP, and cost arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import WHITESPACE, ColumnLike, bind, col, strip

# Wordings that carry no amount.
SENTINELS = (
    "competitive", "doe", "negotiable", "tbc", "tba", "market rate",
    "to be confirmed", "depending on experience", "see advert",
)

# Annual range per pay band number; 8a to 8d are numbers 8 to 11.
BAND_RANGES = {
    1: (22383, 22383),
    2: (23615, 25674),
    3: (24071, 25674),
    4: (26530, 29114),
    5: (29970, 36483),
    6: (37338, 44962),
    7: (46148, 52809),
    8: (53755, 60504),
    9: (62215, 72293),
    10: (74290, 85601),
    11: (88168, 102585),
}
BAND_LETTERS = {"8a": 8, "8b": 9, "8c": 10, "8d": 11}

# How the unit shows in the text, tested in this order.
UNIT_WORDS = {
    "hourly": ("/hr", "per hour", "p/h", "hourly", "per hr"),
    "daily": ("/day", "per day", "daily", "p/d"),
    "sessional": ("per session", "/session", "sessional"),
}

# Units worked per year.
HOURS_PER_YEAR = 1880
DAYS_PER_YEAR = 230
SESSIONS_PER_YEAR = 400

_BLANKS = r"[\s\p{Z}]*"
_POUND_AMOUNT = "£" + _BLANKS + r"[0-9,]+(?:\.[0-9]+)?" + _BLANKS + "[kK]?"
_BARE = r"[0-9,]+(?:\.[0-9]+)?[kK]?"
_RANGE = r"(?U)\b" + _BARE + _BLANKS + "(?:-|[tT][oO]|–)" + _BLANKS + _BARE + r"\b"
_BAND = r"(?U)\bband\s+([0-9]+[abcd]?)\b"
# Everything an amount may carry besides its digits.
_NOT_DIGITS = "£,kK" + WHITESPACE


def _amount(text: Column) -> Column:
    """``£ 35,000.5 k`` to a number; NULL when no digits are left."""
    value = F.translate(text, _NOT_DIGITS, "").try_cast("double")
    return value * F.when(text.rlike("[kK]"), F.lit(1000.0)).otherwise(F.lit(1.0))


def find_amounts(text: ColumnLike) -> Column:
    """All amounts in the text.

    Amounts with a pound sign count always; bare ranges count only when both ends exceed 5000.
    ``£30,000 - £40,000`` is seen by the first rule, ``£30,000 - 40,000`` by both.
    """
    def found(t: Column) -> Column:
        none = F.array().cast("array<double>")
        pounds = F.transform(F.regexp_extract_all(t, F.lit(_POUND_AMOUNT), F.lit(0)), _amount)
        ranges = F.transform(
            F.regexp_extract_all(t, F.lit(_RANGE), F.lit(0)),
            lambda m: F.transform(F.split(m, "-|[tT][oO]|–"), _amount),
        )
        large = F.filter(ranges, lambda r: (F.get(r, F.lit(0)) > 5000) & (F.get(r, F.lit(1)) > 5000))
        return F.concat(
            F.when(t.contains("£"), F.filter(pounds, lambda a: a.isNotNull())).otherwise(none),
            F.when(t.rlike("(?s)[0-9].*(?:-|[tT][oO]|–)"), F.flatten(large)).otherwise(none),
        )

    return bind(col(text), found)


def detect_unit(text: ColumnLike) -> Column:
    text = F.lower(col(text))
    out = F.lit("annual")
    for unit, words in reversed(UNIT_WORDS.items()):
        found = reduce(or_, [text.contains(w) for w in words])
        out = F.when(found, F.lit(unit)).otherwise(out)
    return out


def annualise(
    amount: ColumnLike, unit: ColumnLike,
    hours: ColumnLike | int = HOURS_PER_YEAR, days: ColumnLike | int = DAYS_PER_YEAR,
) -> Column:
    """Whole annual GBP, truncated."""
    factor = (
        F.when(col(unit) == "hourly", F.lit(hours) if isinstance(hours, int) else col(hours))
        .when(col(unit) == "daily", F.lit(days) if isinstance(days, int) else col(days))
        .when(col(unit) == "sessional", F.lit(SESSIONS_PER_YEAR))
        .otherwise(F.lit(1))
    )
    return (col(amount) * factor).cast("bigint")


def afc_band(text: ColumnLike) -> Column:
    """Range struct of the pay band named in the text, or NULL."""
    letters = F.create_map(*[F.lit(x) for kv in BAND_LETTERS.items() for x in kv])
    ranges = F.create_map(
        *[
            x
            for band, (low, high) in BAND_RANGES.items()
            for x in (F.lit(band), F.struct(F.lit(low).cast("bigint").alias("min"),
                                            F.lit(high).cast("bigint").alias("max")))
        ]
    )

    def named(t: Column) -> Column:
        name = F.regexp_extract(t, _BAND, 1)
        number = F.coalesce(F.try_element_at(letters, name), name.try_cast("int"))
        return F.when(t.contains("band"), F.try_element_at(ranges, number))

    return bind(F.lower(col(text)), named)


def default_unit(pack_unit: ColumnLike) -> Column:
    """Unit named by a domain pack, e.g. ``hourly_gbp``."""
    name = F.coalesce(col(pack_unit), F.lit(""))
    out = F.lit("annual")
    for unit in reversed(UNIT_WORDS):
        out = F.when(name.contains(unit), F.lit(unit)).otherwise(out)
    return out


def salary_bounds(amounts: Column) -> Column:
    return F.struct(F.array_min(amounts).alias("min"), F.array_max(amounts).alias("max"))


def parse_salary(
    raw: ColumnLike, pack_unit: ColumnLike | None = None,
    hours: ColumnLike | int = HOURS_PER_YEAR, days: ColumnLike | int = DAYS_PER_YEAR,
    bands: ColumnLike | None = None,
) -> Column:
    """Struct ``(min, max)`` of whole annual GBP; both NULL when nothing can be read.

    ``pack_unit`` supplies the unit when the text names none; ``bands`` (boolean) switches the
    pay-band lookup per row and defaults to on.
    """
    fallback = default_unit(pack_unit) if pack_unit is not None else F.lit("annual")
    use_bands = F.coalesce(col(bands), F.lit(False)) if bands is not None else F.lit(True)

    def from_parts(x: Column) -> Column:
        amounts, band = x["amounts"], x["band"]
        count, low, high = F.size(amounts), F.array_min(amounts), F.array_max(amounts)
        unit = F.when(x["unit"] == "annual", fallback).otherwise(x["unit"])
        unit = F.when((unit == "annual") & (high < 5000), F.lit("hourly")).otherwise(unit)
        unit = F.when((unit == "hourly") & (high > 500), F.lit("annual")).otherwise(unit)
        in_band = F.when(
            count >= 2,
            F.struct(low.cast("bigint").alias("min"), high.cast("bigint").alias("max")),
        ).otherwise(band)

        def yearly(u: Column) -> Column:
            return F.struct(
                annualise(low, u, hours, days).alias("min"), annualise(high, u, hours, days).alias("max")
            )

        return F.when(band.isNotNull(), in_band).when(count > 0, bind(unit, yearly))

    def parsed(text: Column) -> Column:
        parts = F.struct(
            find_amounts(text).alias("amounts"),
            F.when(use_bands, afc_band(text)).alias("band"),
            detect_unit(text).alias("unit"),
        )
        # A text without digits, the usual sentinel included, holds neither amount nor band.
        readable = text.rlike("[0-9]") & ~F.lower(text).isin(*SENTINELS)
        return F.when(readable, bind(parts, from_parts))

    nothing = F.struct(F.lit(None).cast("bigint").alias("min"), F.lit(None).cast("bigint").alias("max"))
    return F.coalesce(bind(strip(raw), parsed), nothing)


def range_text(low: ColumnLike, high: ColumnLike) -> Column:
    """``£20,000 - £25,000`` from numbers; one side alone when the other is empty or zero."""
    def pounds(x: ColumnLike) -> Column:
        return F.when(col(x) != 0, F.concat(F.lit("£"), F.format_number(F.floor(col(x)), 0)))

    return F.nullif(F.concat_ws(" - ", pounds(low), pounds(high)), F.lit(""))


def salary_fallback(raw: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """Pay text to parse: the given text, else a range built from the numeric fields."""
    def shown(x: ColumnLike) -> Column:
        return F.coalesce(F.nullif(F.nullif(col(x).cast("string"), F.lit("0")), F.lit("0.0")), F.lit(""))

    built = F.btrim(F.concat(F.lit("£"), shown(low), F.lit(" - £"), shown(high)), F.lit(" -"))
    has_number = (shown(low) != "") | (shown(high) != "")
    return F.coalesce(F.nullif(col(raw), F.lit("")), F.when(has_number, built))


def api_cost(
    input_tokens: ColumnLike, cached_tokens: ColumnLike, output_tokens: ColumnLike,
    input_rate: ColumnLike, cached_rate: ColumnLike, output_rate: ColumnLike,
) -> Column:
    """Cost in GBP from rates per million tokens; cached input is charged at its own rate."""
    fresh = F.greatest(F.lit(0), col(input_tokens) - col(cached_tokens))
    return (
        fresh * col(input_rate) / 1_000_000
        + col(cached_tokens) * col(cached_rate) / 1_000_000
        + col(output_tokens) * col(output_rate) / 1_000_000
    )
