"""Session settings the plans rely on, and the shared scratch folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ContractError

# Runtime settings only; each is set by `tune` on a session that has not chosen its own value.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One key may hold a third of the rows: split it even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Shuffle files go when their query ends; a plan that runs again makes them again.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings. The driver calls this once; library functions never change a session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the session. A local session may name none and gets one of its own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ContractError("NO_SHARED_FOLDER", "set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="crashmart-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused, so two runs cannot mix rows."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


# Ids are long hex texts: zstd halves them, which the default codec cannot.
SCRATCH = {"compression": "zstd"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts lineage on storage that outlives any executor, and lets the shuffles behind it go."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**SCRATCH).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
