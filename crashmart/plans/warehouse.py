"""Star schema: three small dimensions and one fact per crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import Manifest
from ..functions.dates import month_id
from ..model import CRASH_ID, FACT_SCHEMA, contract_frame
from ..operators.compare import field_differences, field_mismatch, pair_rows

FACT_FIELDS = [f for f in FACT_SCHEMA.fieldNames() if f not in CRASH_ID]


def dim_source(spark: SparkSession, manifest: Manifest, batch_id: str) -> DataFrame:
    return contract_frame(spark, [
        (batch_id, s.source_id, s.source_name, s.jurisdiction_code, s.release_label, s.release_scope)
        for s in sorted(manifest.sources, key=lambda s: s.source_id)],
        "batch_id string, source_id string, source_name string, jurisdiction_code string, release_label string, "
        "release_scope string")


def dim_month(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Every month of the analysis years."""
    years = spark.range(manifest.year_from, manifest.year_to + 1).select(F.col("id").cast("int").alias("calendar_year"))
    return (years.withColumn("calendar_month", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .select(month_id(F.col("calendar_year"), F.col("calendar_month")).alias("month_id"),
                    "calendar_year", "calendar_month"))


def dim_severity(spark: SparkSession, manifest: Manifest, batch_id: str) -> DataFrame:
    return contract_frame(spark, [
        (batch_id, s.source_id, k.code, k.label, s.severity.version, k.text, k.fatal)
        for s in sorted(manifest.sources, key=lambda s: s.source_id) for k in s.severity.definitions()],
        "batch_id string, source_id string, severity_code string, severity_label string, definition_version string, "
        "definition_text string, definition_fatal boolean").drop("definition_fatal")


def dimension_differences(stored: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Dimension rows that are missing, extra or changed."""
    fields = [c for c in expected.columns if c not in keys]
    return pair_rows(stored, expected, keys, fields).filter(
        (F.col("left_count") != F.col("right_count")) | field_mismatch(fields))


def facts(crash: DataFrame) -> DataFrame:
    """A pure projection: no join, no shuffle."""
    return (crash.withColumn("month_id", month_id(F.col("occurrence_year"), F.col("occurrence_month")))
            .select(*FACT_SCHEMA.fieldNames()))


def preflight(crash: DataFrame, sources: DataFrame, severities: DataFrame, months: DataFrame) -> DataFrame:
    """Five dimension-contract counts in one pass over the crash rows."""
    s = sources.select("batch_id", "source_id", F.col("release_scope").alias("dim_scope"))
    v = severities.select("batch_id", "source_id", "severity_code", F.col("definition_version").alias("dim_version"))
    m = months.select(F.col("calendar_year").alias("occurrence_year"), F.col("calendar_month").alias("occurrence_month"),
                      F.col("month_id").alias("dim_month"))
    joined = (crash.join(s, ["batch_id", "source_id"], "left").join(v, ["batch_id", "source_id", "severity_code"], "left")
              .join(m, ["occurrence_year", "occurrence_month"], "left"))
    known_source, known_severity = F.col("dim_scope").isNotNull(), F.col("dim_version").isNotNull()
    return joined.agg(
        F.count_if(~known_source).alias("unknown_source_count"),
        F.count_if(known_source & ~F.col("dim_scope").eqNullSafe(F.col("release_scope"))).alias("release_scope_mismatch_count"),
        F.count_if(~known_severity).alias("unknown_severity_count"),
        F.count_if(known_severity & ~F.col("dim_version").eqNullSafe(F.col("severity_definition_version")))
        .alias("severity_version_mismatch_count"),
        F.count_if(F.col("occurrence_month").isNotNull() & F.col("dim_month").isNull()).alias("unknown_month_count"))


def fact_pairs(crash: DataFrame, fact: DataFrame) -> DataFrame:
    """Expected (left) against stored (right) facts by identity."""
    return pair_rows(facts(crash), fact, CRASH_ID, FACT_FIELDS)


def fact_differences(crash: DataFrame, fact: DataFrame) -> DataFrame:
    pairs = fact_pairs(crash, fact)
    wrong = (F.col("left_count") != F.col("right_count")) | field_mismatch(FACT_FIELDS)
    return pairs.filter(wrong).withColumn("mismatched_fields", field_differences(FACT_FIELDS))


def fact_verification(crash: DataFrame, fact: DataFrame) -> DataFrame:
    """Per source: expected, stored and differing facts."""
    wrong = (F.col("left_count") != F.col("right_count")) | field_mismatch(FACT_FIELDS)
    return fact_pairs(crash, fact).groupBy("source_id").agg(
        F.sum("left_count").alias("expected_count"), F.sum("right_count").alias("actual_count"),
        F.count_if(wrong).alias("difference_count"))
