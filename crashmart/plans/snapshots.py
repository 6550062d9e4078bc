"""Comparison of two snapshots of the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import normal_number
from ..operators.compare import multiset_difference
from ..operators.digests import BUCKETS, pruned_difference
from ..operators.relations import key_sizes
from ..session import materialize


def _as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])


def row_differences(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a surplus on one side. NULL and empty text count as the same value."""
    return multiset_difference(_as_text(before, columns), _as_text(after, columns), columns)


def changed_rows(before: DataFrame, after: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of row_differences for snapshots that are mostly equal: only buckets with unequal digests are compared row by row."""
    return pruned_difference(_as_text(before, columns), _as_text(after, columns), columns, buckets=buckets)


def still_absent(references: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """Earlier unmatched references with a flag telling whether the current snapshot still lacks the target.

    The keys found are written first: joined to a plain table, a target that very many references name can be split.
    """
    found = materialize(current.select(*on).distinct().withColumn("__found", F.lit(True)), "found")
    return references.join(found, on, "left").withColumn("still_absent", F.col("__found").isNull()).drop("__found")


def count_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows changed."""
    zero = F.lit(0).cast("bigint")
    sided = (key_sizes(before, keys, "before_count").withColumn("after_count", zero)
             .unionByName(key_sizes(after, keys, "after_count").withColumn("before_count", zero)))
    return (sided.groupBy(*keys).agg(F.sum("before_count").alias("before_count"), F.sum("after_count").alias("after_count"))
            .filter(F.col("before_count") != F.col("after_count")))


def numerically_equal(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key of right: rows matched in left and whether every matched value equals as an exact number.

    left may hold several rows per key, so it is reduced to its extremes first: all values equal v iff min = max = v.
    """
    ranges = left.groupBy(key).agg(
        F.count(F.lit(1)).alias("matched_rows"),
        *[x for f in fields for x in (F.min(normal_number(f)).alias(f"lo_{f}"), F.max(normal_number(f)).alias(f"hi_{f}"),
                                      F.count_if(normal_number(f).isNull()).alias(f"bad_{f}"))])
    joined = right.join(ranges, key, "left")
    same = F.lit(True)
    for f in fields:
        v = normal_number(f)
        same = same & (F.col(f"lo_{f}") == v) & (F.col(f"hi_{f}") == v) & (F.col(f"bad_{f}") == 0)
    return joined.select(key, F.coalesce("matched_rows", F.lit(0).cast("bigint")).alias("matched_rows"),
                         F.coalesce(same, F.lit(False)).alias("numerically_equal"))
