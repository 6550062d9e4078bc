"""Frozen schemas of every layer, and frames built from contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .contracts import Manifest
from .errors import ContractError

# A contract frame is broadcast only below this many rows; above it Spark plans an ordinary shuffle join.
MAX_BROADCAST_ROWS = 50_000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _int, _long, _flag, _time = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
_texts, _place = T.ArrayType(T.StringType()), T.DecimalType(10, 7)

NOTES = _struct(
    fields=T.ArrayType(_struct(field=_text, reason_code=_text, raw_token=_text, contract_version=_text)),
    location=_struct(reason_code=_text, candidate_raw_record_ids=_texts, resolution=_text, evidence_ref=_text),
    severity_rule=_struct(code=_text, reason=_text, mapping_version=_text))

RAW_SCHEMA = _struct(
    raw_record_id=_text, source_id=_text, resource_id=_text, file_sha256=_text, parser_version=_text, row_locator=_text,
    payload=T.MapType(_text, _text))

CRASH_SCHEMA = _struct(
    batch_id=_text, source_id=_text, release_scope=_text, crash_key=_text, raw_record_id=_text,
    occurrence_year=_int, occurrence_month=_int, occurrence_date=T.DateType(), date_precision=_text,
    severity_raw=_text, severity_code=_text, severity_definition_version=_text, is_fatal_crash=_flag,
    fatality_count=_int, casualty_count=_int, fatal_crash_eligible=_flag, fatality_eligible=_flag, casualty_eligible=_flag,
    latitude=_place, longitude=_place, location_crs=_text, map_eligible=_flag, location_record_id=_text,
    quality_notes=NOTES)

UNIT_SCHEMA = _struct(
    batch_id=_text, source_id=_text, release_scope=_text, unit_key=_text, crash_key=_text, raw_record_id=_text,
    unit_type_raw=_text, unit_type_code=_text, statistical_scope=_text, count_eligible=_flag, quality_notes=NOTES)

FACT_SCHEMA = _struct(
    batch_id=_text, source_id=_text, release_scope=_text, crash_key=_text, occurrence_year=_int, month_id=_int,
    severity_code=_text, is_fatal_crash=_flag, fatality_count=_int, casualty_count=_int,
    fatal_crash_eligible=_flag, fatality_eligible=_flag, casualty_eligible=_flag, latitude=_place, longitude=_place,
    map_eligible=_flag)

_SIDE = _struct(evaluated_count=_long, violation_count=_long, metrics=T.MapType(_text, _long))
REFERENCES = T.ArrayType(_struct(source_id=_text, resource_id=_text, file_sha256=_text, parser_version=_text, detail=_text))
QA_SCHEMA = _struct(
    batch_id=_text, rule_id=_text, object_key=_text, result=_text, affected_count=_long, actual=_SIDE, expected=_SIDE,
    evidence=_struct(reason_codes=_texts, resolution=_text, references=REFERENCES, producer_version=_text),
    raw_record_id=_text, checked_at=_time)

BATCH_SCHEMA = _struct(
    batch_id=_text, dataset_kind=_text, status=_text, input_fingerprint=_text, manifest=_text,
    started_at=_time, finished_at=_time, error=_text)

CRASH_ID = ["batch_id", "source_id", "release_scope", "crash_key"]
UNIT_ID = ["batch_id", "source_id", "release_scope", "unit_key"]
RAW_IDENTITY = ["resource_id", "file_sha256", "parser_version", "row_locator"]
FILE_IDENTITY = ["source_id", "resource_id", "file_sha256", "parser_version"]


def contract_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A frame made from declared values. The row count is known here, so the broadcast is checked here."""
    df = spark.createDataFrame(rows, ddl)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def require_schema(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Names, order and types must equal the frozen schema."""
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    wanted = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if actual != wanted:
        raise ContractError("SCHEMA", f"{what} differs from its contract",
                            missing=[w for w in wanted if w not in actual], extra=[a for a in actual if a not in wanted])
    return df


def file_frame(spark: SparkSession, manifest: Manifest) -> DataFrame:
    return contract_frame(spark, [
        (f.source_id, f.resource_id, f.file_sha256, f.parser_version, f.role, f.raw_count,
         manifest.source(f.source_id).release_scope, list(f.header), list(f.key_fields), f.parent_resource_id,
         list(f.parent_fields), list(f.parent_crash_fields))
        for f in manifest.files()],
        "source_id string, resource_id string, file_sha256 string, parser_version string, role string, raw_count bigint, "
        "release_scope string, header array<string>, key_fields array<string>, parent_resource_id string, "
        "parent_fields array<string>, parent_crash_fields array<string>")


def coverage_frame(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Declared coverage as distinct (source, year, month, basis) rows."""
    entries = contract_frame(spark, [
        (s.source_id, c.year_from, c.year_to, list(c.months), c.basis) for s in manifest.sources for c in s.coverage],
        "source_id string, year_from int, year_to int, months array<int>, basis string")
    return (entries.withColumn("covered_year", F.explode(F.sequence("year_from", "year_to")))
            .select("source_id", "covered_year", F.explode("months").alias("covered_month"), "basis").distinct())
