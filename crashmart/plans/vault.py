"""Key hubs, attribute snapshots, links, and the typed rows read back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import CRASH_ID, CRASH_SCHEMA, UNIT_ID, UNIT_SCHEMA, require_schema
from ..operators.filters import attributes_of

CRASH_KEYS = [*CRASH_ID, "raw_record_id"]
UNIT_KEYS = [*UNIT_ID, "raw_record_id"]


def hub_rows(existing: DataFrame, projected: DataFrame, key: str) -> DataFrame:
    """Keys not seen before, with the batch that saw them first."""
    ids = ["source_id", "release_scope", key]
    new = projected.groupBy(*ids).agg(F.min("batch_id").alias("first_batch_id"))
    return new.join(existing.select(*ids), ids, "left_anti")


def crash_satellite(crash: DataFrame) -> DataFrame:
    return attributes_of(crash, CRASH_KEYS)


def unit_satellite(unit: DataFrame) -> DataFrame:
    """Attributes keep the parent key, so the link can be checked against them."""
    return attributes_of(unit, UNIT_KEYS)


def links(unit: DataFrame) -> DataFrame:
    return unit.select(*UNIT_ID, "crash_key")


def read_crash(satellite: DataFrame) -> DataFrame:
    return satellite.select(*CRASH_KEYS, "attributes.*").select(*CRASH_SCHEMA.fieldNames())


def read_unit(satellite: DataFrame, link: DataFrame) -> DataFrame:
    """Unit snapshot joined to its link; keys are unique on both sides."""
    linked = satellite.join(link.withColumnRenamed("crash_key", "link_crash_key"), UNIT_ID, "left")
    return linked.select(*UNIT_KEYS, "attributes.*", "link_crash_key")


def canonical_crash(satellite: DataFrame) -> DataFrame:
    return require_schema(read_crash(satellite), CRASH_SCHEMA, "crash rows")


def canonical_unit(satellite: DataFrame, link: DataFrame) -> DataFrame:
    return require_schema(read_unit(satellite, link).select(*UNIT_SCHEMA.fieldNames()), UNIT_SCHEMA, "unit rows")


def link_conflicts(satellite: DataFrame, link: DataFrame) -> DataFrame:
    """Units whose stored parent differs from their link, or that have no link."""
    return read_unit(satellite, link).filter(~F.col("crash_key").eqNullSafe(F.col("link_crash_key")))
