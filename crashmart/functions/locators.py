"""Row locators: ``csv:N`` and ``["sheet", N]``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

# The two locator forms.
CSV_LOCATOR = r"\Acsv:([1-9][0-9]*)\z"
SHEET_LOCATOR = r'\A\["(?:[^"\\]|\\.)+", ?([1-9][0-9]*)\]\z'


def locator_position(locator: str | Column) -> Column:
    """Native position of any length up to 38 digits, NULL for any other form."""
    c = col(locator)
    return F.coalesce(
        F.regexp_extract(c, CSV_LOCATOR, 1).try_cast("decimal(38,0)"),
        F.regexp_extract(c, SHEET_LOCATOR, 1).try_cast("decimal(38,0)"),
    )


def locator_order(locator: str | Column) -> Column:
    """Sort key on the trailing digits, so that csv:10 follows csv:9."""
    return F.regexp_extract(col(locator), r"([0-9]+)\z", 1).try_cast("decimal(38,0)")
