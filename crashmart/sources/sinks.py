"""Slice writers, append-only result sinks and current-release views."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..operators.relations import no_rows
from ..session import materialize
from .inventory import as_uri, qualified

SLICE = ["batch_id", "source_id", "release_scope"]


def write_slices(df: DataFrame, path: str) -> None:
    """Replace exactly the (batch, source, release) slices present in df; other slices stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SLICE).parquet(path))


def read_slices(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def append_results(results: DataFrame, path: str) -> None:
    """Append quality rows; a (batch, rule, object) already stored or repeated in the input is refused."""
    spark, keys = results.sparkSession, ["batch_id", "rule_id", "object_key"]
    results = materialize(results, "results")      # the checks below must not run every quality plan again
    repeated = results.groupBy(*keys).count().filter("count > 1")
    if not no_rows(repeated):
        raise ContractError("QA_REPEATED", "a result object occurs twice")
    if _exists(spark, path):
        stored = spark.read.parquet(path).select(*keys)
        if not no_rows(results.join(stored, keys, "left_semi")):
            raise ContractError("QA_REWRITE", "stored results are append-only")
    results.write.mode("append").partitionBy("batch_id").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _file_writer(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Writes sorted rows (name, line) of a task into a folder that gets its final name when it is whole, so a retried task leaves it once."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(as_uri(path))
        made, kept = f"{root}/_temporary/{task.partitionId()}-{task.taskAttemptId()}", f"{root}/part-{task.partitionId():05d}"
        store.create_dir(made, recursive=True)
        count, open_name, stream = 0, None, None
        for batch in batches:
            for name, line in zip(batch["name"], batch["line"], strict=True):
                if name != open_name:
                    if stream:
                        stream.close()
                    stream, open_name, count = store.open_output_stream(f"{made}/{quote(name, safe='= ')}.txt"), name, count + 1
                stream.write(line + b"\n")
        if stream:
            stream.close()
        if store.get_file_info(kept).type == fs.FileType.NotFound:
            store.move(made, kept)
        else:
            store.delete_dir(made)
        yield pd.DataFrame({"files": [count]})
    return write


def write_text_files(df: DataFrame, key: str, text: str, path: str) -> int:
    """One text file for each key, ``part-N/key=value.txt``, with a line for each of its rows in a task; the number of files.

    Like a write partitioned by the key, but with one folder for each task. A folder for each key costs several calls of the file
    system, and a rename on the driver, for each of them. Neither column may be NULL.
    """
    named = df.select(F.concat(F.lit(f"{key}="), F.col(key).cast("string")).alias("name"), F.col(text).cast("binary").alias("line"), key).sortWithinPartitions(key)
    written = named.select("name", "line").mapInPandas(_file_writer(qualified(df.sparkSession, path)), "files bigint")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def write_differences(details: DataFrame, path: str, expected_count: int) -> None:
    """One JSON line per affected identity; the stored count must equal the reported one."""
    details.write.option("ignoreNullFields", "false").json(path)
    written = details.sparkSession.read.schema(details.schema).json(path).count()
    if written != expected_count:
        raise ContractError("EVIDENCE_COUNT", "stored differences do not match the metric",
                            written=written, expected=expected_count)


def current_pointer(batches: DataFrame) -> DataFrame:
    """Latest succeeded batch per kind."""
    return (batches.filter("status = 'succeeded'").groupBy("dataset_kind")
            .agg(F.max_by("batch_id", F.struct("finished_at", "batch_id")).alias("batch_id")))


def current_rows(pointer: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of the batches the pointer names. The pointer has one row per dataset kind (two at most)."""
    return F.broadcast(pointer).join(table, "batch_id")


def register_current_views(batches: DataFrame, tables: dict[str, DataFrame], prefix: str = "current_") -> list[str]:
    pointer = current_pointer(batches)
    names = []
    for name, table in tables.items():
        current_rows(pointer, table).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
