"""Text predicates and business-key encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The 29 code points that count as white space in a key or token.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


# One character outside the set decides at the first position it meets, which is nearly always the first character.
_NOT_WHITESPACE = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"


def is_blank(value: str | Column) -> Column:
    """True for NULL, empty or all-white-space text. Never NULL. Plain trim would only know U+0020."""
    return ~F.coalesce(col(value).rlike(_NOT_WHITESPACE), F.lit(False))


def any_blank(values: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [is_blank(v) for v in values])


def missing_token(value: str | Column, empty_is_missing: bool = True) -> Column:
    """NULL for an absent token; empty text is absent only where the source says so."""
    return F.nullif(col(value), F.lit("")) if empty_is_missing else col(value)


def trimmed_or_null(value: str | Column) -> Column:
    return F.nullif(F.trim(col(value)), F.lit(""))


def try_encode_key(*parts: str | Column) -> Column:
    """Compact JSON array of the unchanged parts, or NULL when any part is blank."""
    values = [col(p).cast("string") for p in parts]
    if not values:
        raise ValueError("a business key needs at least one part")
    return F.when(~any_blank(values), F.to_json(F.array(*values)))


def encode_key(*parts: str | Column) -> Column:
    """Like try_encode_key, but a blank part fails the job instead of yielding NULL."""
    return F.coalesce(
        try_encode_key(*parts),
        F.raise_error(F.lit("business key parts must be non-null and non-blank")).cast("string"),
    )


def spaced_key(*parts: str | Column) -> Column:
    """The same key printed with a blank after each comma, for comparison with exports that print it so."""
    items = F.array(*[col(p).cast("string") for p in parts])
    printed = F.transform(items, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"\A\[|\]\z", ""))
    return F.when(try_encode_key(*parts).isNotNull(), F.concat(F.lit("["), F.array_join(printed, ", "), F.lit("]")))
