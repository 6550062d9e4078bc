"""Token counts of the documents of flat token files without an index.

A flat token file is a run of token ids in which an end-of-document id follows every document. Files come in blocks of tokens; a block is
searched for the id by one vector comparison. A document may reach over any number of blocks, so three numbers go from block to
block: the tokens, the documents and the last end before it. They are prefix scans over the blocks of a file, made in two levels: inside
groups of `GROUP` blocks, then over the groups, so that even a file that holds a third of all tokens is scanned in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import materialize

BLOCK = 65_536      # tokens
GROUP = 256         # blocks
END = 50_256


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_files(docs: DataFrame, ranks: str, end: int = END, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as flat token files, one for each input partition, written in blocks: file, block, payload (16-bit little-endian ids),
    doc_ids (of the documents that end in the block, in order; only to name the counts). Null texts are empty documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, file, number = _encoding(ranks), TaskContext.get().partitionId(), 0
        held, size, ids = [], 0, []

        def cut(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, size, ids, number
            tokens, at = np.concatenate([*held, np.empty(0, "<u2")]), 0
            while size - at >= block or (last and at < size):
                part = tokens[at: at + block]
                n = int((part == end).sum())
                yield pd.DataFrame({"file": [file], "block": [number], "payload": [part.tobytes()], "doc_ids": [ids[:n]]})
                ids, number, at = ids[n:], number + 1, at + block
            held, size = [tokens[at:]], max(0, size - at)

        for batch in batches:
            for doc, t in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                held.append(np.array([*encoding.encode_ordinary(t or ""), end], "<u2"))
                size += len(held[-1])
                ids.append(None if doc is pd.NA else int(doc))
                if size >= 4 * block:
                    yield from cut(False)
        yield from cut(True)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(source.mapInPandas(run, "file int, block long, payload binary, doc_ids array<long>"), "tokens")


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of flat files in any store that Spark reads; `file` numbers the paths in order. Files are cut after they are read, so each has
    to fit into a task (shards of at most a few hundred MB)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    numbered = files.withColumn("parts", F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / (2 * block)) - 1)))
    cut = numbered.select("path", "content", F.explode("parts").alias("block"))
    return cut.select(F.xxhash64("path").alias("file"), F.col("block").cast("long"), F.expr(f"substring(content, cast(block * {2 * block} + 1 as int), {2 * block})").alias("payload"),
                      F.lit(None).cast("array<long>").alias("doc_ids"))


def _ends(end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [np.frombuffer(p, "<u2") for p in batch["payload"]]
            yield pd.DataFrame({"file": batch["file"], "block": batch["block"], "size": [len(t) for t in tokens],
                                "ends": [np.flatnonzero(t == end) for t in tokens], "doc_ids": batch["doc_ids"]})
    return run


def token_counts(blocks: DataFrame, end: int = END) -> DataFrame:
    """file, doc_no (from 0), doc_id (null if unnamed), start, n_tokens (the end id not counted), ended.

    Every end id ends a document, an empty one too. Tokens after a file's last end id are a document with ended = false. Null payloads
    are empty blocks; a file without tokens has no rows. (file, block) must be unique.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = materialize(blocks.select("file", "block", F.coalesce("payload", F.lit(b"")).alias("payload"), "doc_ids")
                        .mapInPandas(_ends(end), f"file {kind}, block long, size long, ends array<long>, doc_ids array<long>"), "ends")
    each = found.select("file", "block", F.floor(F.col("block") / GROUP).alias("group"), "size", F.size("ends").cast("long").alias("docs"),
                        F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    local = materialize(each.withColumn("tokens_in", F.coalesce(F.sum("size").over(inside), none)).withColumn("docs_in", F.coalesce(F.sum("docs").over(inside), none))
                        .withColumn("own_last", F.col("tokens_in") + F.col("last")).withColumn("last_in", F.max("own_last").over(inside)), "blocks")
    totals = local.groupBy("file", "group").agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"), F.max("own_last").alias("last"))
    groups = (totals.withColumn("tokens_before", F.coalesce(F.sum("size").over(over), none)).withColumn("docs_before", F.coalesce(F.sum("docs").over(over), none))
              .withColumn("last_before", F.max(F.col("tokens_before") + F.col("last")).over(over)))
    groups = materialize(groups.select("file", "group", "tokens_before", "docs_before", "last_before"), "groups")
    at = local.join(groups, ["file", "group"]).select(
        "file", "block", (F.col("tokens_before") + F.col("tokens_in")).alias("offset"), (F.col("docs_before") + F.col("docs_in")).alias("docs"),
        (F.greatest(F.col("tokens_before") + F.col("last_in"), F.col("last_before"), F.lit(-1)) + 1).alias("first"))
    spread = found.join(at, ["file", "block"]).select("file", "offset", "docs", "first", "ends", "doc_ids", F.posexplode("ends").alias("n", "end"))
    starts = F.when(F.col("n") == 0, F.col("first")).otherwise(F.col("offset") + F.get("ends", F.col("n") - 1) + 1)
    done = spread.select("file", (F.col("docs") + F.col("n")).alias("doc_no"), F.get("doc_ids", F.col("n")).alias("doc_id"), starts.alias("start"),
                         (F.col("offset") + F.col("end") - starts).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = local.groupBy("file").agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"))
    lasts = groups.join(local.groupBy("file", "group").agg(F.max("own_last").alias("l")), ["file", "group"]).groupBy("file").agg(F.max(F.coalesce(F.col("tokens_before") + F.col("l"), F.lit(-1))).alias("last"))
    open_ = whole.join(lasts, "file").where("last + 1 < size").select("file", F.col("docs").alias("doc_no"), F.lit(None).cast("long").alias("doc_id"),
                                                                     (F.col("last") + 1).alias("start"), (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.union(open_)
