"""Aggregate expressions in which unknown never becomes zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_where(value: Column, condition: Column) -> Column:
    """NULL, not 0, when no row qualifies."""
    return F.sum(F.when(condition, value.cast("bigint")))


def distinct_extra(value: Column) -> Column:
    """Rows beyond the first of each value (NULLs count as extra rows)."""
    return F.count(F.lit(1)) - F.countDistinct(value)


def ordered_distinct_text(value: Column, separator: str = " | ") -> Column:
    """Sorted distinct join, for label columns whose distinct values are bounded by a contract."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(value)), separator), F.lit(""))


def absolute_delta_sum(left: Column, right: Column) -> Column:
    return F.sum(F.abs(left.cast("bigint") - right.cast("bigint")))


def percentage(part: Column, whole: Column) -> Column:
    """100*part/whole half-up to two places in integer arithmetic; NULL when whole is 0."""
    p, w = part.cast("decimal(38,0)"), whole.cast("decimal(38,0)")
    hundredths = F.floor((p * 20000 + w) / (w * 2)).cast("decimal(9,0)")
    return F.when(whole > 0, (hundredths * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(7,2)"))
