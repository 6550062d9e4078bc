"""Exclusive commits: of several writers that start from the same state one wins, the others see that they lost.

A claim is an empty file that can be made once. It rests on the file system's own exclusive creation: java.io.File.createNewFile on local
folders, create without overwrite elsewhere (atomic on HDFS). An object store without conditional writes cannot tell two writers
apart; there publication needs one writer.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(target)


def claim(spark: SparkSession, folder: str, name: str) -> bool:
    """Make the file `name` in `folder`. False when it is there already; other errors are raised."""
    fs, place = _place(spark, folder)
    fs.mkdirs(place)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(place, name)
    if fs.getScheme() == "file":
        return jvm.java.io.File(target.toUri().getPath()).createNewFile()
    try:
        fs.create(target, False).close()
    except Py4JJavaError as exc:
        if "AlreadyExists" in exc.java_exception.getClass().getName() or fs.exists(target):
            return False
        raise
    return True


def last_number(spark: SparkSession, folder: str) -> int:
    """Highest number claimed in a folder of numbered commits, 0 for none. One small file stands for one publication."""
    fs, place = _place(spark, folder)
    if not fs.exists(place):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def claim_next(spark: SparkSession, folder: str, seen: int) -> bool:
    """Claim the number after the one that the writer saw before it began. A number without a log row belongs to a writer that died."""
    return claim(spark, folder, f"{seen + 1:020d}")
