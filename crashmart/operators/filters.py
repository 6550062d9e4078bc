"""Row predicates shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def within_years(df: DataFrame, year: str, year_from: int, year_to: int) -> DataFrame:
    """Closed interval. Apply only after whole-snapshot checks."""
    return df.filter(F.col(year).between(year_from, year_to))


def among(df: DataFrame, column: str, values: list | tuple | None) -> DataFrame:
    """No filter when values is None; otherwise NULL never qualifies."""
    return df if values is None else df.filter(F.col(column).isin(list(values)))


def in_months(df: DataFrame, months: list[int] | tuple[int, ...] | None, month_id: str = "month_id") -> DataFrame:
    return df if months is None else df.filter((F.col(month_id) % 100).isin(list(months)))


def differs(left: Column, right: Column) -> Column:
    """NULL-aware inequality: never NULL."""
    return ~left.eqNullSafe(right)


def any_differs(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(False)
    for left, right in pairs:
        out = out | differs(left, right)
    return out


def undeclared(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Known values outside a declared set. The set is contract-sized, so it stays a literal predicate."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(declared))


def existing(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def absent(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def attributes_of(df: DataFrame, keys: list[str], name: str = "attributes") -> DataFrame:
    """Keys plus one struct of everything else."""
    return df.select(*keys, F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias(name))
