"""Exact duplicates against immutable snapshots: binary-fuse filters screen digests, bytes decide.

Texts are equal when they are the same after white space `[\\x20\\x09-\\x0D]` is deleted. Rows come in batches. A batch that has been taken in is
a snapshot: one row for each class (distinct digest) in exact buckets by a 64-bit key, and for each shard of the keys one static
binary-fuse filter (three probes, 8-bit prints), built once and never changed. The next batch

1. is reduced to its own classes: duplicates inside a batch are grouped by digest, before anything else;
2. meets the filters of every earlier snapshot with its keys alone; a key that a filter does not hold is new, without a look at the snapshot;
3. takes positives to the exact bucket of their key, where the normalised texts of one row of either class are compared byte by
   byte; only equal ones join the snapshot's class.

A filter holds about `KEYS` keys (some ten kilobytes), so the number of shards grows with the snapshot and no task sees more; a shard's
incoming keys are dealt to further parts beyond the same number. Joins with rows or texts are hinted to merge and their other side is
written first, so that a class with a third of all rows splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import materialize, text_key

SPACE = r"[\x20\x09-\x0D]+"
KEYS = 8192          # keys of a filter, about
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@dataclass(frozen=True)
class Fuse:
    """A binary-fuse filter: three neighbouring segments hold one slot each of a key; the xor of the slots is the key's print."""
    seed: int
    segment: int
    segments: int
    prints: bytes

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, own = _slots(keys, self.seed, self.segment, self.segments)
        prints = np.frombuffer(self.prints, np.uint8)
        return prints[slots[0]] ^ prints[slots[1]] ^ prints[slots[2]] == own


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(keys.astype(U) + U(seed))
    first = ((h >> U(32)) * U(segment * segments)) >> U(32)
    mask = U(segment - 1)
    second, third = (first + U(segment)) ^ ((h >> U(18)) & mask), (first + U(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), (_mix(h) >> U(56)).astype(np.uint8)


def build(keys: np.ndarray) -> Fuse:
    """The filter of some distinct 64-bit keys. Slots with one key are peeled in rounds; prints are set in reverse order of the peeling."""
    n = len(keys)
    segment = 1 << int(log(max(n, 2)) / log(3.33) + 2.25)
    spread = max(1.125, 0.875 + 0.25 * log(1e6) / log(max(n, 2)))
    segments = max(1, ceil(n * spread / segment) - 2)
    for seed in range(0x9E3779B97F4A7C15, 2**64, 0x1000000001B3):
        slots, own = _slots(keys, seed, segment, segments)
        held, sums = np.zeros((segments + 2) * segment, np.int64), np.zeros((segments + 2) * segment, np.int64)
        for part in slots:
            np.add.at(held, part, 1)
            np.add.at(sums, part, np.arange(n))
        order, single = [], np.flatnonzero(held == 1)
        while len(single):
            key, at = np.unique(sums[single], return_index=True)
            order.append((key, single[at]))
            touched = slots[:, key].ravel()
            np.subtract.at(held, touched, 1)
            np.subtract.at(sums, touched, np.tile(key, 3))
            single = np.unique(touched[held[touched] == 1])
        if sum(len(key) for key, _ in order) == n:
            prints = np.zeros(len(held), np.uint8)
            for key, slot in reversed(order):
                prints[slot] = own[key] ^ prints[slots[0, key]] ^ prints[slots[1, key]] ^ prints[slots[2, key]]
            return Fuse(seed, segment, segments, prints.tobytes())
    raise ValueError("no seed gives a filter; keys repeat")


FILTER = "shard long, seed string, segment int, segments int, prints binary"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    made = build(np.unique(rows["key"].to_numpy(np.int64)).view(U))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "seed": [str(made.seed)], "segment": [made.segment], "segments": [made.segments], "prints": [made.prints]})


def _screened(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    found = np.zeros(len(keys), bool)
    for row in filters.itertuples():
        found |= Fuse(int(row.seed), row.segment, row.segments, row.prints).contains(keys["key"].to_numpy(np.int64).view(U))
    return keys.loc[found, ["key"]]


def normal(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def bucket_key(sha: Column) -> Column:
    """What filters and buckets know of a digest; several digests may share a key."""
    return F.xxhash64(sha)


@dataclass(frozen=True)
class Snapshot:
    """Classes of one batch (key, sha, members, best, row_a, row_b) and the filters of its keys, one row for each shard."""
    batch: int
    classes: DataFrame
    filters: DataFrame
    shards: int


def snapshot(classes: DataFrame, batch: int) -> Snapshot:
    shards = max(1, ceil(classes.count() / KEYS))
    sharded = classes.select("key", F.pmod("key", F.lit(shards)).alias("shard"))
    return Snapshot(batch, classes, materialize(sharded.groupBy("shard").applyInPandas(_built, FILTER), "filters"), shards)


def screen(keys: DataFrame, before: Snapshot) -> DataFrame:
    """The distinct keys (one column) that some filter of the snapshot may hold; about one key in 256 is held by chance."""
    parts = max(1, ceil(keys.count() / (before.shards * KEYS)))
    dealt = keys.select("key", F.pmod("key", F.lit(before.shards)).alias("shard"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    filters = before.filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(_screened, "key long")


def _checked(source: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose normalised texts have the same bytes. pairs: (sha, old, old_a, old_b, new_a, new_b), digests of both and rows by their text_key."""
    wanted = materialize(pairs.select("sha", "old", F.explode(F.array(F.struct(F.col("old_a").alias("row_a"), F.col("old_b").alias("row_b"), F.lit(0).alias("side")),
                                                               F.struct(F.col("new_a").alias("row_a"), F.col("new_b").alias("row_b"), F.lit(1).alias("side")))).alias("w"))
                         .select("sha", "old", "w.*"), "wanted")
    texts = source.join(wanted.hint("merge"), ["row_a", "row_b"]).select("sha", "old", "side", normal(F.col("text")).alias("bytes"))
    one = materialize(texts.groupBy("sha", "old", "side").agg(F.first("bytes").alias("bytes")), "compared")
    old, new = one.where("side = 0").select("sha", "old", "bytes"), one.where("side = 1").select("sha", "old", F.col("bytes").alias("other"))
    return old.join(new.hint("merge"), ["sha", "old"]).where(F.col("bytes") == F.col("other")).select("sha")


def exact_dedup(docs: DataFrame, batch: Column | None = None, batches: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, batch.

    batch is a number from 0 below `batches`, by default from a hash of doc_id: batch 0 is the first snapshot, later ones are screened
    against all before. Of a group the row with the most code points in its original text stays, then the smallest doc_id (null last),
    then one of the repeated rows; kept marks that one row. Null texts count as empty; empty and blank texts are one group. Empty
    tables give no rows. Other columns of docs are ignored.
    """
    batch = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches)) if batch is None else batch
    row = text_key(F.col("doc_id"), F.col("text"))
    source = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), batch.cast("int").alias("batch"))
              .select("*", row["a"].alias("row_a"), row["b"].alias("row_b")))
    sha = F.sha2(normal(F.col("text")), 256)
    points = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = source.select("doc_id", "batch", "row_a", "row_b", points.alias("points"), sha.alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("key", bucket_key(F.col("sha"))), "digests")
    best = F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    classes = materialize(rows.groupBy("batch", "key", "sha").agg(F.count(F.lit(1)).alias("members"), F.min(best).alias("best"),
                                                                 F.min(F.struct("row_a", "row_b")).alias("one")), "classes")

    snapshots, joined = [], []
    for number in range(batches):
        own = classes.where(F.col("batch") == number)
        matched = own.select("sha", F.lit(number).alias("root")).limit(0)
        for before in snapshots:
            held = materialize(screen(own.select("key").distinct(), before), "positives")
            pairs = (own.join(held.hint("merge"), "key").select("key", "sha", "one").alias("n")
                     .join(before.classes.select("key", "sha", "one").hint("merge").alias("o"), F.col("n.key") == F.col("o.key")))
            pairs = pairs.select("n.sha", F.col("o.sha").alias("old"), F.col("o.one.row_a").alias("old_a"), F.col("o.one.row_b").alias("old_b"), F.col("n.one.row_a").alias("new_a"), F.col("n.one.row_b").alias("new_b"))
            matched = matched.union(_checked(source, pairs).select("sha", F.lit(before.batch).alias("root")))
        roots = own.join(materialize(matched.groupBy("sha").agg(F.min("root").alias("root")), "matched").hint("merge"), "sha", "left")
        joined.append(roots.withColumn("root", F.coalesce("root", "batch")))
        if number + 1 < batches:
            snapshots.append(snapshot(materialize(joined[-1].where("root = batch").select("key", "sha", "one"), "snapshot"), number))
    placed = materialize(reduce(DataFrame.union, joined), "placed")
    groups = materialize(placed.groupBy("root", "sha").agg(F.sum("members").alias("group_size"), F.min("best").alias("best")), "groups")
    fates = materialize(placed.select("batch", "sha", "root").join(groups.hint("merge"), ["root", "sha"]).select("batch", "sha", "group_size", "best"), "fates")
    return rows.join(fates.hint("merge"), ["batch", "sha"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"), "batch")


EXACT_SQL = """
with rows as (select row_number() over () as row, doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body from documents),
ranked as (select doc_id, row_number() over w as place, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size, sha256(body) as text_sha256
           from rows window w as (partition by body order by length(text) desc, doc_id nulls last, row))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from ranked
"""
