"""Raw records on disk: one object per native row, partitioned by source, resource and file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import FileSpec
from ..functions.locators import locator_position
from ..model import FILE_IDENTITY, RAW_SCHEMA

JSON_ROWS = 500_000
PARTITIONS = ["source_id", "resource_id", "file_sha256"]


def write_records(records: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """fmt json keeps the interchange form, parquet is the working form. JSON repeats every field name and hash, so it is compressed; a
    compressed file is read by one task, which bounds its rows."""
    options = {"ignoreNullFields": "false", "compression": "gzip", "maxRecordsPerFile": JSON_ROWS} if fmt == "json" else {}
    records.write.mode(mode).partitionBy(*PARTITIONS).format(fmt).options(**options).save(path)


def read_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    # FAILFAST: a record that does not fit the declared shape must not turn into NULLs.
    reader = spark.read.format(fmt).schema(RAW_SCHEMA)
    return (reader.option("mode", "FAILFAST") if fmt == "json" else reader).load(path).select(*RAW_SCHEMA.fieldNames())


def record_checks(records: DataFrame, files: DataFrame) -> DataFrame:
    """Per declared file: rows, declared rows, bad locators, repeated positions, rows beyond the last position.

    A position sequence is strictly increasing exactly when no position repeats, so the check needs no ordering pass:
    one aggregate by position, one by file.
    """
    placed = records.select(*FILE_IDENTITY, locator_position("row_locator").alias("position"))
    by_position = placed.groupBy(*FILE_IDENTITY, "position").agg(F.count(F.lit(1)).alias("n"))
    observed = by_position.groupBy(*FILE_IDENTITY).agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("position").isNull(), F.col("n"))), F.lit(0)).alias("bad_locator_count"),
        F.coalesce(F.sum(F.when(F.col("position").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated_position_count"),
        F.max("position").alias("last_position"))
    zero = F.lit(0).cast("bigint")
    return (files.select(*FILE_IDENTITY, "raw_count").join(observed, FILE_IDENTITY, "full_outer")
            .select(*FILE_IDENTITY, F.coalesce("row_count", zero).alias("row_count"), "raw_count",
                    F.coalesce("bad_locator_count", zero).alias("bad_locator_count"),
                    F.coalesce("repeated_position_count", zero).alias("repeated_position_count"), "last_position",
                    F.col("row_count").eqNullSafe(F.col("raw_count")).alias("count_match")))


def select_file(raw: DataFrame, spec: FileSpec) -> DataFrame:
    """Rows of exactly one frozen file. Literal filters, so partition directories are pruned."""
    return raw.filter(
        (F.col("source_id") == spec.source_id) & (F.col("resource_id") == spec.resource_id)
        & (F.col("file_sha256") == spec.file_sha256) & (F.col("parser_version") == spec.parser_version))


def selected_snapshot(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of all frozen files with their role and release scope."""
    return raw.join(files.select(*FILE_IDENTITY, "role", "release_scope"), FILE_IDENTITY)


def payload_shape_errors(records: DataFrame, header: list[str]) -> DataFrame:
    """Records whose payload lacks a declared field or carries an undeclared one."""
    declared = F.array(*[F.lit(h) for h in header])
    keys = F.map_keys("payload")
    return (records
            .withColumn("missing_fields", F.array_sort(F.array_except(declared, keys)))
            .withColumn("extra_fields", F.array_sort(F.array_except(keys, declared)))
            .filter((F.size("missing_fields") > 0) | (F.size("extra_fields") > 0)))
