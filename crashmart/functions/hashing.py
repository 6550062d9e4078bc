"""Content hashes and deterministic row identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

KEEP_NULLS = {"ignoreNullFields": "false"}


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 hex of the JSON object, independent of the order in which fields are given."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, KEEP_NULLS), 256)


def record_id(*identity: str | Column) -> Column:
    """The same identity always gives the same id, so a repeated load reuses it."""
    return F.sha2(F.to_json(F.array(*[col(c).cast("string") for c in identity])), 256)
