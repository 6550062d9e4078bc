"""Small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

__all__ = ["components", "materialize", "numbered", "text_key"]


def text_key(*parts: Column) -> Column:
    """128-bit key of a tuple of values as two longs; null and empty differ. Equal keys are taken as equal values."""
    parts = [F.coalesce(p.cast("string"), F.lit("\u0000null")) for p in parts]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over links (a, b), read in both directions.

    nodes: one column `node` (long, no repeats); nodes without a link keep themselves and take no part in the rounds. Large star: each
    node sends its greater neighbours to the smallest of its neighbourhood. Small star: each node sends its smaller neighbours, and
    itself, to the smallest of them. Neither adds links, and repeats fall together, so that links shrink to one for each node; a
    round without change leaves every node beside its smallest one. Links and the smallest neighbours are written first, so that a hub's
    links are a plain join side that Spark may split.
    """
    def linked(rows: DataFrame) -> DataFrame:
        """(u, v) with u > v, each once."""
        return materialize(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")

    def size(rows: DataFrame):
        return rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = linked(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    state = size(now)
    while state[0]:
        near = now.select(F.col("u").alias("node"), F.col("v").alias("low")).union(now.select(F.col("v").alias("node"), F.col("v").alias("low")))
        lows = materialize(near.groupBy("node").agg(F.min("low").alias("low")), "lows")
        large = linked(now.join(lows.hint("merge"), F.col("v") == F.col("node")).select("u", F.col("low").alias("v")))
        lows = materialize(large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")), "lows")
        small = large.join(lows.hint("merge"), F.col("u") == F.col("node")).select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("x"))
        now, before = linked(small.select("x.*")), state
        state = size(now)
        if state == before:
            break
    return nodes.join(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a total order. `order` should end with a column without repeats, so that equal rows can part.

    Range partitions are sorted and written with a counter in each; the driver reads one count for each partition, and the sums before
    each are a broadcast of as many rows as there were shuffle partitions.
    """
    written = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), name)
    part, within = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for row in written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before.append((row["part"], total))
        total += row["n"]
    starts = rows.sparkSession.createDataFrame(before, f"{name}_part long, {name}_start long")
    placed = written.join(F.broadcast(starts), part == F.col(f"{name}_part"))
    return placed.select(*rows.columns, (within + F.col(f"{name}_start") + 1).alias(name))
