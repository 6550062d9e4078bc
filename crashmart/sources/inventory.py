"""File inventory with content hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError

CHUNK = 8 << 20


def as_uri(path: str) -> str:
    """A path as Hadoop prints it, escaped as an URI."""
    return quote(path, safe="/:@")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark would take for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream each listed file through SHA-256 in bounded memory; a hash is sequential, so a file is one unit of work."""
    from pyarrow import fs
    for batch in batches:
        digests = []
        for uri in batch["path"]:
            store, name = fs.FileSystem.from_uri(as_uri(uri))
            digest = hashlib.sha256()
            with store.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(file_sha256=digests)


def _hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files of each listed folder whose name fits; a folder whose name fits gives its files and those of partition folders (a=b), as Spark's listing does."""
    from pyarrow import fs
    for batch in batches:
        for folder, pattern in zip(batch["folder"], batch["pattern"], strict=True):
            store, root = fs.FileSystem.from_uri(as_uri(folder))
            root, fits, found = root.rstrip("/"), re.compile(pattern, re.S).fullmatch, []
            # No pattern: the folder itself was asked for.
            todo = [x for x in store.get_file_info(fs.FileSelector(root)) if fits(x.base_name)] if pattern else [store.get_file_info(root)]
            inside = {x.path for x in todo}
            while todo:
                x = todo.pop()
                if x.type == fs.FileType.Directory and (x.path in inside or ("=" in x.base_name and not _hidden(x.base_name))):
                    todo += store.get_file_info(fs.FileSelector(x.path))
                elif x.type == fs.FileType.File and not _hidden(x.base_name):
                    found.append((folder.rstrip("/") + x.path[len(root):], x.size))
            yield pd.DataFrame(found, columns=["path", "byte_size"]).astype({"byte_size": "int64"})


def _folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, pattern of the names in it, empty for the folder itself) for a path or glob. The names themselves are left to the tasks: no file passes the driver unless the
    path has braces, which may hold slashes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    glob = hadoop.GlobPattern(target.getName())
    if glob.hasWildcard() and "{" not in path:
        pattern = glob.compiled().pattern()
        found = [(x.getPath().toString(), pattern) for x in store.globStatus(target.getParent()) or [] if x.isDirectory()]
    else:
        found = [(x.getPath().toString(), "") if x.isDirectory() else (x.getPath().getParent().toString(), re.escape(x.getPath().getName()))
                 for x in store.globStatus(target) or []]
    if not found:
        raise ContractError("NO_FILES", "the path does not exist", path=path)
    return found


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, file_sha256) per file. Tasks list the folders, which reads no content, and hash what was listed."""
    width = spark.sparkContext.defaultParallelism
    listed = (spark.createDataFrame(_folders(spark, path), "folder string, pattern string").repartition(width)
              .mapInPandas(_list_files, "path string, byte_size bigint"))
    return (listed.repartition(width)
            .mapInPandas(_hash_files, "path string, byte_size bigint, file_sha256 string"))


def compare_with_pinned(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """pinned: (path, file_sha256). One row per path known to either side with hash_match."""
    return (found.select("path", "byte_size", F.col("file_sha256").alias("actual_sha256"))
            .join(pinned.select("path", F.col("file_sha256").alias("expected_sha256")), "path", "full_outer")
            .withColumn("hash_match", F.col("actual_sha256").eqNullSafe(F.col("expected_sha256"))))


def file_summary(records: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue entry per declared file with its observed row count; files without rows stay with 0."""
    ids = ["source_id", "resource_id", "file_sha256", "parser_version"]
    counts = records.groupBy(*ids).agg(F.count(F.lit(1)).alias("actual_count"))
    return (files.join(counts, ids, "left")
            .withColumn("actual_count", F.coalesce("actual_count", F.lit(0).cast("bigint")))
            .withColumn("count_match", F.col("actual_count").eqNullSafe(F.col("raw_count"))))
