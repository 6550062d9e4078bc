"""Comparison of two row sets.

Both sides are stacked and grouped by key instead of outer-joined: one shuffle, map-side combining, and a key repeated on
both sides can never multiply into pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filters import any_differs

LEFT, RIGHT = "left", "right"


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str], delta: str = "extra_count") -> DataFrame:
    """Rows with unequal multiplicity: side names where the surplus is, delta how many. NULLs equal NULLs."""
    sided = left.select(*columns, F.lit(1).alias("__d")).unionByName(right.select(*columns, F.lit(-1).alias("__d")))
    net = sided.groupBy(*columns).agg(F.sum("__d").alias("__net")).filter("__net <> 0")
    return net.select(*columns, F.when(F.col("__net") > 0, LEFT).otherwise(RIGHT).alias("side"),
                      F.abs("__net").alias(delta))


def pair_rows(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key of either side: left_count, right_count, and the field struct of each side (NULL if absent)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("__side"), F.struct(*[F.col(f) for f in fields]).alias("__row"))

    both = side(left, LEFT).unionByName(side(right, RIGHT))
    is_left, is_right = F.col("__side") == LEFT, F.col("__side") == RIGHT
    return both.groupBy(*keys).agg(
        F.count_if(is_left).alias("left_count"), F.count_if(is_right).alias("right_count"),
        F.max(F.when(is_left, F.col("__row"))).alias("left_row"),
        F.max(F.when(is_right, F.col("__row"))).alias("right_row"))


def field_differences(fields: list[str]) -> Column:
    """Names of the fields that differ between left_row and right_row."""
    return F.array_compact(F.array(*[
        F.when(~F.col(f"left_row.{f}").eqNullSafe(F.col(f"right_row.{f}")), F.lit(f)) for f in fields]))


def field_mismatch(fields: list[str]) -> Column:
    """True when both sides exist and some field differs. Never NULL."""
    present = (F.col("left_count") > 0) & (F.col("right_count") > 0)
    return present & any_differs([(F.col(f"left_row.{f}"), F.col(f"right_row.{f}")) for f in fields])


def identity_difference(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Set difference both ways: state missing (expected only) or unexpected (observed only)."""
    sided = expected.select(*keys, F.lit(True).alias("e")).unionByName(observed.select(*keys, F.lit(False).alias("e")))
    seen = sided.groupBy(*keys).agg(F.bool_or("e").alias("has_e"), F.bool_or(~F.col("e")).alias("has_o"))
    return (seen.filter(F.col("has_e") != F.col("has_o"))
            .select(*keys, F.when(F.col("has_e"), "missing").otherwise("unexpected").alias("state")))
