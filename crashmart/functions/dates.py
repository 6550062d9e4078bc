"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import guarded_cast
from .text import col

# The English month names used by native files.
MONTHS = ("January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December")


def month_number(name: str | Column) -> Column:
    """1..12 for an English month name with optional outer blanks, else NULL."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    return F.try_element_at(table, F.trim(col(name)))


def iso_date(token: str | Column) -> Column:
    """Date written strictly as YYYY-MM-DD, else NULL. Year 0 does not exist."""
    day = guarded_cast(token, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "date")
    return F.when(F.year(day) >= 1, day)


def year_token(token: str | Column, pattern: str, low: int, high: int) -> Column:
    year = guarded_cast(token, pattern, "int")
    return F.when(year.between(low, high), year)


def date_precision(month: Column, day: Column) -> Column:
    return F.when(month.isNull(), "year").when(day.isNull(), "month").otherwise("day")


def month_id(year: Column, month: Column) -> Column:
    """year*100+month; NULL when the month is unknown."""
    return (year * 100 + month).cast("int")


def month_of_id(value: Column) -> Column:
    return (value % 100).cast("int")


def year_of_id(value: Column) -> Column:
    return F.floor(value / 100).cast("int")
