"""Guarded numeric parsing. A pattern always decides before a cast: casts alone accept blanks and short forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import col

INT_MAX = 2147483647
# \z, not $: in Java $ also matches before a final line break.
DIGITS = r"\A[0-9]+\z"
EXACT = "decimal(38,34)"
SCALE7 = "decimal(10,7)"


def guarded_cast(value: str | Column, pattern: str, to: str) -> Column:
    c = col(value)
    return F.when(c.rlike(pattern), c.try_cast(to))


def count_token(value: str | Column) -> Column:
    """Non-negative int32 written in ASCII digits, else NULL."""
    return guarded_cast(value, DIGITS, "int")


def decimal_token(value: str | Column) -> Column:
    """Exact decimal with 34 fractional digits, NULL when the token is no finite number below 10,000."""
    return col(value).try_cast(EXACT)


# A finite number as it may be written, blanks around it allowed; casts alone also take type suffixes and hexadecimal forms.
NUMBER = r"\A\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,30})?\s*\z"
_PARTS = r"\A\s*([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\s*\z"


def _digits_and_magnitude(c: Column) -> tuple[Column, Column]:
    """Digits without outer zeros, and the place of the first of them: the number is 0.digits times ten to the magnitude."""
    whole, both = F.regexp_extract(c, _PARTS, 2), F.concat(F.regexp_extract(c, _PARTS, 2), F.regexp_extract(c, _PARTS, 3))
    lead = F.regexp_replace(both, "^0+", "")
    power = F.coalesce(F.regexp_extract(c, _PARTS, 4).try_cast("decimal(38,0)"), F.lit(0))
    return F.regexp_replace(lead, "0+$", ""), power + F.length(whole) - F.length(both) + F.length(lead)


def normal_number(value: str | Column) -> Column:
    """One text for all ways to write a number of any length, NULL for other tokens. Numbers are equal exactly if these texts are."""
    c = col(value)
    digits, magnitude = _digits_and_magnitude(c)
    text = F.concat(F.when(F.regexp_extract(c, _PARTS, 1) == "-", "-").otherwise(""), F.lit("0."), digits, F.lit("e"), magnitude.cast("string"))
    return F.when(c.rlike(NUMBER), F.when(digits == "", "0").otherwise(text))


def within(value: str | Column, limit: int) -> Column:
    """The number lies in -limit..limit, all its digits considered. NULL for a NULL token, false for what is no number."""
    c = col(value)
    digits, magnitude = _digits_and_magnitude(c)
    places = len(str(limit))
    inside = (digits == "") | (magnitude < places) | ((magnitude == places) & (digits <= str(limit).rstrip("0")))
    return c.rlike(NUMBER) & inside


def exact_pair(lat: str | Column, lon: str | Column) -> Column:
    """struct(lat, lon, lat_text, lon_text), NULL unless both are numbers in range. The texts are normal forms, so that pairs that differ
    in any digit differ here; the decimals are for rounding and order."""
    good = F.coalesce(within(lat, 90) & within(lon, 180), F.lit(False))
    return F.when(good, F.struct(decimal_token(lat).alias("lat"), decimal_token(lon).alias("lon"),
                                 normal_number(lat).alias("lat_text"), normal_number(lon).alias("lon_text")))


PAIR_TYPE = f"struct<lat:{EXACT},lon:{EXACT},lat_text:string,lon_text:string>"


def to_scale7(value: Column) -> Column:
    """Half-up to seven places; compare exact values before calling this."""
    return value.cast(SCALE7)


def known_sum(*values: Column) -> Column:
    """64-bit sum that is NULL as soon as one part is unknown."""
    return reduce(lambda a, b: a + b, [v.cast("bigint") for v in values])
