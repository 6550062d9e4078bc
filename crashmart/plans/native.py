"""The native files read anew: what a build holds its stored records against.

Each declared file is scanned once into raw records that are written; hash, header and count come from the files themselves, never from the
contract or from what was stored before.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import FileSpec, Manifest
from ..errors import ContractError
from ..session import materialize
from ..sources.delimited import gate_counts, headers, scan, to_records
from ..sources.inventory import inventory

OBSERVED = ["resource_id", "actual_sha256", "actual_header", "actual_count"]


def set_hash(files: DataFrame) -> DataFrame:
    """One row: the hash of a single file, or of a set of files a hash of their number and of sums over their hashes, whatever their order."""
    piece = lambda at: F.sum(F.conv(F.substring("file_sha256", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return files.agg(F.count(F.lit(1)).alias("n"), F.min("file_sha256").alias("one"), piece(1).alias("p"), piece(16).alias("q"), piece(31).alias("r")).select(
        F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, F.sha2(F.concat_ws(":", "n", "p", "q", "r"), 256)).alias("actual_sha256"))


def read_file(spark: SparkSession, path: str, spec: FileSpec) -> tuple[DataFrame, DataFrame]:
    """(observed, records) of one file set. Files with unlike headers have no header; rows that are no records of the form are refused."""
    rows = materialize(scan(spark, path, spec), "native")
    bad = gate_counts(rows, spec).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("row_width_mismatch", "nul_character", "invalid_utf8")]).first().asDict()
    if any(bad.values()):
        raise ContractError("NATIVE_FORMAT", "a native file has rows that are no records", resource_id=spec.resource_id, **bad)
    cells = headers(spark, path).agg(F.min("cells").alias("least"), F.max("cells").alias("most")).select(
        F.when(F.col("least") == F.col("most"), F.col("least")).alias("actual_header"))
    count = rows.agg(F.count(F.lit(1)).alias("actual_count"))
    # Three one-row frames side by side.
    observed = reduce(lambda a, b: a.join(b, "resource_id"), [f.withColumn("resource_id", F.lit(spec.resource_id)) for f in (set_hash(inventory(spark, path)), cells, count)])
    return observed.select(*OBSERVED), to_records(rows, spec)


def read_native(spark: SparkSession, manifest: Manifest, files: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(observed, records) of all declared files. files: a path for each resource_id."""
    lost = [f.resource_id for f in manifest.files() if f.resource_id not in files]
    if lost:
        raise ContractError("NATIVE_FILE", "every declared file needs a path", resource_ids=lost)
    parts = [read_file(spark, files[f.resource_id], f) for f in manifest.files()]
    observed, records = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    return materialize(observed, "observed"), records
