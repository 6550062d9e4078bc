"""Keys, parents and children.

Counts are taken on keys that were aggregated first: a key holding a third of all rows leaves the map side as one row.
Where every row must learn something about its group, `attach` joins to group rows that were written first. Both sides of that join
are then plain shuffles, which adaptive execution splits when a key is large; a join straight to an aggregate of the same key is
one it cannot split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


def no_rows(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def key_sizes(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their row count."""
    return key_sizes(df, keys).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Child keys without a parent, with the number of child rows. NULL keys count as orphans."""
    return key_sizes(children, on).join(parents.select(*on).distinct(), on, "left_anti")


def declared_vs_observed(parents: DataFrame, key: list[str], declared: Column, children: DataFrame) -> DataFrame:
    """Every parent row with declared, observed (0 when childless) and delta = observed - declared."""
    counts = key_sizes(children, key, "observed_count")
    zero = F.lit(0).cast("bigint")
    return (parents.withColumn("declared_count", declared.cast("bigint")).join(counts, key, "left")
            .withColumn("observed_count", F.coalesce("observed_count", zero))
            .withColumn("count_delta", F.col("observed_count") - F.col("declared_count")))


def attach(detail: DataFrame, groups: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Left join of many detail rows to unique group rows, whatever the size of a key. Rows with a NULL key go around the join."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    lookup = materialize(groups.select(*on, *[F.col(v).alias(f"__g_{v}") for v in values]), "groups")
    own = [F.col(f"`{c}`") for c in detail.columns]
    found = detail.filter(known).join(lookup, on, "left").select(*own, *[F.col(f"__g_{v}").alias(v) for v in values])
    kinds = {f.name: f.dataType for f in groups.schema.fields}
    return found.union(detail.filter(~known).select(*own, *[F.lit(None).cast(kinds[v]).alias(v) for v in values]))


def category_totals(df: DataFrame, column: Column, categories: DataFrame, name: str, count: str) -> DataFrame:
    """Counts for every listed category, explicit 0 where none occurs. categories: (name, display_order)."""
    counts = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias(count))
    return (categories.join(counts, name, "left")
            .withColumn(count, F.coalesce(count, F.lit(0).cast("bigint"))))


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n examples per group. The rank limit is pushed below the shuffle, so each task sends n rows per group."""
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("example_no", rank).filter(F.col("example_no") <= n)
