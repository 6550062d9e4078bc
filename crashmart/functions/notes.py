"""Structured reasons stored next to a value that is missing or was withheld."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIELD_TYPE = "struct<field:string,reason_code:string,raw_token:string,contract_version:string>"
LOCATION_TYPE = "struct<reason_code:string,candidate_raw_record_ids:array<string>,resolution:string,evidence_ref:string>"
RULE_TYPE = "struct<code:string,reason:string,mapping_version:string>"
NOTES_TYPE = f"struct<fields:array<{FIELD_TYPE}>,location:{LOCATION_TYPE},severity_rule:{RULE_TYPE}>"

# Every reason a location may carry.
LOCATION_REASONS = ("missing", "unmapped", "definition_unconfirmed", "invalid_coordinate",
                    "crs_unconfirmed", "location_conflict", "no_location")


def fields_note(entries: list[tuple[str, Column, Column, str]], version: str) -> Column:
    """entries: (field, condition, raw token, reason). NULL when no condition holds."""
    items = F.array(*[
        F.when(condition, F.struct(
            F.lit(field).alias("field"), F.lit(reason).alias("reason_code"),
            token.cast("string").alias("raw_token"), F.lit(version).alias("contract_version")).cast(FIELD_TYPE))
        for field, condition, token, reason in entries
    ])
    kept = F.array_compact(items)
    return F.when(F.size(kept) > 0, kept)


def location_note(reason: Column, candidates: Column, resolution: Column, evidence: str) -> Column:
    return F.struct(
        reason.alias("reason_code"), candidates.cast("array<string>").alias("candidate_raw_record_ids"),
        resolution.alias("resolution"), F.lit(evidence).alias("evidence_ref")).cast(LOCATION_TYPE)


def severity_rule_note(code: str, reason: str, version: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"),
                    F.lit(version).alias("mapping_version")).cast(RULE_TYPE)


def quality_notes(fields: Column | None = None, location: Column | None = None, rule: Column | None = None) -> Column:
    return F.struct(
        (fields if fields is not None else F.lit(None)).alias("fields"),
        (location if location is not None else F.lit(None)).alias("location"),
        (rule if rule is not None else F.lit(None)).alias("severity_rule"),
    ).cast(NOTES_TYPE)
