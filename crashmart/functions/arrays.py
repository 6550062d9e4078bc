"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def position_of(array: Column, item: object) -> Column:
    """1-based position, NULL when absent."""
    return F.nullif(F.array_position(array, item), F.lit(0).cast("bigint"))
