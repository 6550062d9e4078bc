"""Dense calendars built from declared values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def year_spine(sources: DataFrame, year_from: int, year_to: int) -> DataFrame:
    return sources.withColumn("period_year", F.explode(F.sequence(F.lit(year_from), F.lit(year_to))))


def month_spine(sources: DataFrame, year_from: int, year_to: int, months: list[int]) -> DataFrame:
    return year_spine(sources, year_from, year_to).withColumn(
        "period_month", F.explode(F.array(*[F.lit(m) for m in months])))
