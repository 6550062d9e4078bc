"""What the two vector searches share: usable vectors, copies, and meeting two sides of a group in blocks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialize

SALTS = 64


def usable(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a non-empty vector of finite components, as doubles. Other rows take no part."""
    own = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))


def lowest_of_each(rows: DataFrame, most: int) -> DataFrame:
    """rows (id, v, a, b) without copies that can be in no result: of equal vectors, (a, b) being their key, the `most` lowest ids stay.

    With scores equal, ties go to the lower id, so a copy beyond these is never among the `most` best. A repeated row counts once. Copies
    are dealt over salts first, so no task sorts a whole group of copies.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    part = rows.dropDuplicates(["id", "a", "b"]).withColumn("salt", salt).withColumn("n", F.row_number().over(Window.partitionBy("a", "b", "salt").orderBy("id"))).where(F.col("n") <= most)
    return part.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("n") <= most).drop("n", "salt")


def meet(left: DataFrame, right: DataFrame, group: str, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
         left_size: int, right_size: int) -> DataFrame:
    """fn over every block of left with every block of right of the same group; both have `id` (long) and the group column.

    A block holds some left_size or right_size rows, whatever the size of the group. There is one count for each group, so groups must be
    bounded in number (leaves of a tree, lengths of vectors).
    """
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)      # they may come from one frame
    sizes = left.groupBy(group).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(group).agg(F.count(F.lit(1)).alias("r")), group)
    blocks = F.broadcast(materialize(sizes.select(group, F.ceil(F.col("l") / left_size).cast("int").alias("l"), F.ceil(F.col("r") / right_size).cast("int").alias("r")), "blocks"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        return (rows.join(blocks, group).withColumn(f"{own}_block", F.pmod(F.xxhash64("id", F.lit(own)), F.col(own)).cast("int"))
                .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("l", "r"))

    keys = [group, "l_block", "r_block"]
    return dealt(left, "l", "r").groupBy(*keys).cogroup(dealt(right, "r", "l").groupBy(*keys)).applyInPandas(fn, schema)


def best(found: DataFrame, k: int, query: str = "query") -> DataFrame:
    """The k best rows (score, then lower id) of each query, with their rank from 1."""
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
