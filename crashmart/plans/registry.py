"""Registration and idempotent raw load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import record_id
from ..model import RAW_IDENTITY, RAW_SCHEMA
from ..operators.relations import no_rows
from ..errors import ContractError


def payload_text(payload: str = "payload") -> F.Column:
    """Order-independent text of a payload map, usable for comparison and grouping."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))), {"ignoreNullFields": "false"})


def register(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows to insert. Registering the same values again is fine; different values under one key are a conflict."""
    others = [c for c in incoming.columns if c != key]
    both = existing.select(key, *others).unionByName(incoming.select(key, *others)).distinct()
    if not no_rows(both.groupBy(key).count().filter("count > 1")):
        raise ContractError("REGISTRATION_CONFLICT", "a registered key was given other values")
    return incoming.distinct().join(existing.select(key), key, "left_anti")


def load_states(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per identity of the incoming records: state insert | reuse | conflict, and the id it has or gets.

    An identity seen twice with different payloads is a conflict as well.
    """
    def side(df: DataFrame, is_new: bool) -> DataFrame:
        return df.select("source_id", *RAW_IDENTITY, payload_text().alias("text"), F.lit(is_new).alias("is_new"))

    seen = side(stored, False).unionByName(side(incoming, True))
    groups = seen.groupBy("source_id", *RAW_IDENTITY).agg(
        F.bool_or("is_new").alias("asked"), F.bool_or(~F.col("is_new")).alias("known"),
        F.min("text").alias("low"), F.max("text").alias("high"))
    state = F.when(F.col("low") != F.col("high"), "conflict").when(F.col("known"), "reuse").otherwise("insert")
    return groups.filter("asked").select(
        record_id(*RAW_IDENTITY).alias("raw_record_id"), "source_id", *RAW_IDENTITY, state.alias("state"))


def rows_to_insert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New records only; ids derive from the identity, so a repeated or retried load yields the same rows."""
    fresh = load_states(stored, incoming).filter("state = 'insert'").select(*RAW_IDENTITY)
    one = incoming.dropDuplicates(RAW_IDENTITY)
    return one.join(fresh, RAW_IDENTITY, "left_semi").select(*RAW_SCHEMA.fieldNames())


def replay_differences(native: DataFrame, stored: DataFrame) -> DataFrame:
    """Native records against stored ones by locator: one row per identity with its reason codes (empty when equal)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*RAW_IDENTITY, "source_id", payload_text().alias("text"), F.lit(name).alias("side"))

    both = side(native, "native").unionByName(side(stored, "raw"))
    n, r = F.col("side") == "native", F.col("side") == "raw"
    groups = both.groupBy(*RAW_IDENTITY).agg(
        F.count_if(n).alias("native_count"), F.count_if(r).alias("raw_count"),
        F.max(F.when(n, F.col("text"))).alias("native_text"),
        F.min(F.when(r, F.col("text"))).alias("raw_low"), F.max(F.when(r, F.col("text"))).alias("raw_high"),
        F.max(F.when(n, F.col("source_id"))).alias("native_source"),
        F.min(F.when(r, F.col("source_id"))).alias("raw_source_low"), F.max(F.when(r, F.col("source_id"))).alias("raw_source_high"))
    has_n, has_r = F.col("native_count") > 0, F.col("raw_count") > 0
    reasons = F.array_compact(F.array(
        F.when(has_n & ~has_r, "RAW_MISSING_LOCATOR"), F.when(has_r & ~has_n, "RAW_EXTRA_LOCATOR"),
        F.when(F.col("raw_count") > 1, "RAW_DUPLICATE_LOCATOR"),
        F.when(has_n & has_r & ((F.col("raw_low") != F.col("native_text")) | (F.col("raw_high") != F.col("native_text"))),
               "RAW_PAYLOAD_MISMATCH"),
        F.when(has_n & has_r & ((F.col("raw_source_low") != F.col("native_source"))
                                | (F.col("raw_source_high") != F.col("native_source"))), "RAW_IDENTITY_MISMATCH")))
    return groups.select(*RAW_IDENTITY, "native_count", "raw_count", reasons.alias("reason_codes"))


def replay_summary(differences: DataFrame) -> DataFrame:
    """Per file: counts needed by the raw quality object."""
    has = lambda code: F.array_contains("reason_codes", code)
    return differences.groupBy("resource_id", "file_sha256", "parser_version").agg(
        F.sum("native_count").alias("native_count"), F.sum("raw_count").alias("raw_count"),
        F.count_if(F.col("raw_count") > 0).alias("distinct_locator_count"),
        F.count_if(has("RAW_PAYLOAD_MISMATCH")).alias("payload_mismatch_count"),
        F.count_if(has("RAW_MISSING_LOCATOR")).alias("missing_count"),
        F.count_if(has("RAW_EXTRA_LOCATOR")).alias("extra_count"),
        F.count_if(has("RAW_DUPLICATE_LOCATOR")).alias("duplicate_count"),
        F.count_if(F.size("reason_codes") > 0).alias("affected_count"))
