"""Order-free digests of row sets: equal parts of two snapshots are recognised without sending their rows.

A digest is the number of rows and the sums of two 64-bit row hashes, so it does not depend on order, files or partitions,
adds up map-side, and counts repeated rows. NULL differs from every value and from nothing being there. Two unequal row sets share a
digest with a chance of about 2^-128; hashes are no defence against rows made to collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .compare import multiset_difference, pair_rows

BUCKETS = 4096
_SEEDS = (0, 1, 2)     # bucket, first sum, second sum: three independent hashes


def row_hash(columns: list[str], seed: int) -> Column:
    """64-bit hash of the columns in order. The hash function skips NULLs, so each value goes with its NULL flag."""
    parts = [p for c in columns for p in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *parts)


def _summands(columns: list[str]) -> list[Column]:
    # decimal(19,0) sums to decimal(29,0): no overflow below 10^10 rows in one digest, and an error, no wrong sum, beyond.
    return [row_hash(columns, seed).cast("decimal(19,0)").alias(f"__h{seed}") for seed in _SEEDS[1:]]


def group_digests(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: row_count and digest, a text of count and sums. One aggregate, combined map-side."""
    hashed = df.select(*keys, *_summands(columns))
    sums = [F.sum(f"__h{seed}") for seed in _SEEDS[1:]]
    count = F.count(F.lit(1))
    return hashed.groupBy(*keys).agg(
        count.alias("row_count"), F.concat_ws(":", count.cast("string"), *[s.cast("string") for s in sums]).alias("digest"))


def _bucket(columns: list[str], buckets: int) -> Column:
    return F.pmod(row_hash(columns, _SEEDS[0]), F.lit(buckets)).cast("int")


def open_buckets(left: DataFrame, right: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Buckets whose row sets differ: at most `buckets` rows, found by one aggregate of signed sums over both sides."""
    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(_bucket(columns, buckets).alias("__bucket"), F.lit(sign).alias("__n"),
                         *[(h * sign).alias(f"__s{i}") for i, h in enumerate(_summands(columns))])

    net = side(left, 1).unionByName(side(right, -1)).groupBy("__bucket").agg(*[F.sum(c).alias(c) for c in ("__n", "__s0", "__s1")])
    return net.filter("__n <> 0 or __s0 <> 0 or __s1 <> 0").select("__bucket")


def pruned_difference(left: DataFrame, right: DataFrame, columns: list[str], delta: str = "extra_count", buckets: int = BUCKETS) -> DataFrame:
    """The rows of compare.multiset_difference, of which only open buckets are grouped row by row.

    Both sides are read twice and equal snapshots shuffle digests only. It pays where few rows changed: with d changed rows
    at most 2d buckets are open, so `buckets` should be a multiple of the changes that are expected. Results are the same for any number.
    """
    # At most `buckets` numbers by construction, so they go to every task; written first, they are found once for both sides.
    found = F.broadcast(materialize(open_buckets(left, right, columns, buckets), "open-buckets"))

    def part(df: DataFrame) -> DataFrame:
        kept = df.select(*[F.col(f"`{c}`") for c in columns]).withColumn("__bucket", _bucket(columns, buckets))
        return kept.join(found, "__bucket", "left_semi").drop("__bucket")

    return multiset_difference(part(left), part(right), columns, delta)


def _placed(df: DataFrame, group: list[str], keys: list[str], buckets: int) -> DataFrame:
    """Adds __group and __bucket, never NULL: rows of one key always share both."""
    return df.withColumns({"__group": row_hash(group, _SEEDS[0]), "__bucket": F.pmod(row_hash(keys, _SEEDS[0]), F.lit(buckets)).cast("int")})


def pruned_pairs(left: DataFrame, right: DataFrame, group: list[str], keys: list[str], fields: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of compare.pair_rows without those of buckets in which both sides hold equal rows.

    Keys left out have equal counts and equal rows on both sides, so whoever looks for differences misses none. A bucket holds keys of one
    `group` (few values, such as a source), so that a group full of differences opens no bucket of another. Both sides are read twice.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*[F.col(c) for c in dict.fromkeys([*group, *keys, *fields])], F.lit(sign).alias("__n"))

    # Hashed after the union, which gives both sides the same types.
    stacked = _placed(side(left, 1).unionByName(side(right, -1)), group, keys, buckets)
    hashed = stacked.select("__group", "__bucket", "__n", *[row_hash([*keys, *fields], seed).alias(f"__h{seed}") for seed in _SEEDS[1:]])
    # Halves of the hashes, so that plain bigint sums cannot overflow below 2^31 rows.
    sums = [F.sum(F.col("__n") * half) for seed in _SEEDS[1:] for half in (F.shiftright(f"__h{seed}", 32), F.col(f"__h{seed}").bitwiseAND(F.lit(0xFFFFFFFF)))]
    net = hashed.groupBy("__group", "__bucket").agg(F.sum("__n").alias("__n"), *[s.alias(f"__s{i}") for i, s in enumerate(sums)])
    unequal = " or ".join(f"{c} <> 0" for c in ("__n", *[f"__s{i}" for i in range(len(sums))]))
    # At most groups x buckets rows.
    found = F.broadcast(materialize(net.filter(unequal).select("__group", "__bucket"), "open-buckets"))

    def part(df: DataFrame) -> DataFrame:
        return _placed(df, group, keys, buckets).join(found, ["__group", "__bucket"], "left_semi")

    return pair_rows(part(left), part(right), keys, fields)
