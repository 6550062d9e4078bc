"""Alignment of two tokenizers over the same bytes: a byte-level BPE (A) and a BPE of pieces with byte fallback (B).

A encodes a space and the text, B the text (it adds the space itself), so the tokens of both cover the same bytes. Per batch, pandas
merge_asof finds for each token start the token of the other side that covers it; the union of both directions is all overlaps. Token
positions carry the place of their document in the batch, which keys the merge by document. Overlaps that end together are links, and
common ends cut the tokens into groups.

Tokens of a text are those of its chunks: both tokenizers end a token before a space or line feed between characters that are surely
not white space, and after such a line feed. A task encodes a distinct chunk once and remembers it.

A pair's count over the corpus must come back to each document. Documents are gathered into blocks of some `BLOCK` links, one row each, that
hold their links as compressed places in the block's list of distinct pairs. Lists are counted in Spark, and each block gets the counts of
its own distinct pairs back, so what is shuffled is a block's vocabulary and not its text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize
from .word_tokens import byte_letters

SURE = "[!-~À-ɏ]"       # surely not white space for either tokenizer
CUT = re.compile(f"(?<={SURE})(?=[ \n]{SURE})|(?<={SURE}\n)(?={SURE})")
CACHED = 400_000                  # distinct chunks that a task remembers
CHARS = 2_000_000                 # characters that are aligned at once, one text at least
BLOCK = 1 << 21                   # links of a block, one text at least
FIELDS = ["n_a", "n_b", "n_groups", "n_links"]


class Pair:
    """Both tokenizers: token bytes, and the ids of chunks as little-endian unsigned 32-bit numbers."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = {c: b for b, c in byte_letters().items()}
        with open(byte_level, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(len(self.b))))]
        self.a_size, self.b_size = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])
        # The decimal id before a comma, and before the mark that ends its side of a group.
        self.a_text = np.array([f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([f"{i}," for i in range(len(self.b_bytes))] + [f"{i};" for i in range(len(self.b_bytes))], object)
        self.forget()

    def forget(self) -> None:
        self.a_ids: dict[str, bytes] = {}
        self.b_ids: dict[str, bytes] = {}
        self.bad: set[str] = set()

    def learn(self, chunks: set[str]) -> None:
        """Encodes new chunks. A chunk without a space in front is given to B behind a line feed, whose two tokens are dropped again."""
        if len(self.a_ids) > CACHED:
            self.forget()
        new = [c for c in chunks if c not in self.a_ids]
        a_all = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        b_all = self.b.encode([c[1:] if c[0] == " " else "\n" + c for c in new], num_threads=1)
        for chunk, a, b in zip(new, a_all, b_all, strict=True):
            b = b if chunk[0] == " " else b[2:]
            plain = chunk.encode()
            if b"".join([self.a_bytes[i] for i in a]) != plain or b"".join([self.b_bytes[i] for i in b]) != plain:
                self.bad.add(chunk)
            self.a_ids[chunk], self.b_ids[chunk] = np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides for each text; None for texts without tokens (null, empty, or a side with other bytes than the text)."""
        split = [CUT.split(" " + t) if t else [] for t in texts]
        self.learn({c for own in split for c in own})
        return [(b"".join(map(self.a_ids.__getitem__, own)), b"".join(map(self.b_ids.__getitem__, own))) if own and self.bad.isdisjoint(own) else None for own in split]


@lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


@dataclass
class Overlaps:
    """Tokens of some documents, one after the other, and all pairs (a, b) of their places that share a byte, by start."""
    a_id: np.ndarray
    b_id: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens that end together, in order."""
        both = self.a_end[self.a] == self.b_end[self.b]
        return self.a[both], self.b[both]


def overlaps(a_id: np.ndarray, b_id: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Overlaps:
    """All overlaps of two token sequences over the same bytes, by one merge_asof for each direction."""
    a_end, b_end = np.cumsum(a_size[a_id]), np.cumsum(b_size[b_id])
    a = pd.DataFrame({"start": a_end - a_size[a_id], "a": np.arange(len(a_id))})
    b = pd.DataFrame({"start": b_end - b_size[b_id], "b": np.arange(len(b_id))})
    from_a, from_b = pd.merge_asof(a, b, on="start"), pd.merge_asof(b, a, on="start")
    twice = a["start"].to_numpy()[from_b["a"].to_numpy()] == from_b["start"].to_numpy()       # both start here: found from a already
    left, right = np.concatenate([from_a["a"], from_b["a"][~twice]]), np.concatenate([from_a["b"], from_b["b"][~twice]])
    order = np.lexsort((right, left))
    return Overlaps(a_id, b_id, a_end, b_end, left[order], right[order])


def written_groups(found: Overlaps, one: Pair, ends: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each document; ends are the places behind its last A and last B token."""
    a, b = found.links
    a_last, b_last = np.zeros(len(found.a_id), bool), np.zeros(len(found.b_id), bool)
    a_last[a], b_last[b] = True, True
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last       # number of the group that a token is in
    before_b, before_a = np.concatenate([[0], b + 1]), np.concatenate([[0], a + 1])
    text = np.empty(len(a_group) + len(b_group), object)
    text[np.arange(len(a_group)) + before_b[a_group]] = one.a_text[found.a_id + a_last * len(one.a_bytes)]
    text[np.arange(len(b_group)) + before_a[b_group + 1]] = one.b_text[found.b_id + b_last * len(one.b_bytes)]
    edges = np.concatenate([[0], ends.sum(1)]).tolist()
    return ["".join(text[s:e].tolist())[:-1] for s, e in pairwise(edges)]


def aligned(texts: list[str | None], one: Pair) -> tuple[np.ndarray, list[str | None], np.ndarray]:
    """For some texts: FIELDS as columns, the written groups (None without tokens), and the links as a id times B's size plus b id."""
    ids = one.encode(texts)
    full = [i for i, x in enumerate(ids) if x]
    numbers, groups = np.zeros((len(texts), len(FIELDS)), np.int64), [None] * len(texts)
    if not full:
        return numbers, groups, np.empty(0, np.int64)
    a_id, b_id = (np.frombuffer(b"".join([ids[i][side] for i in full]), "<u4").astype(np.int64) for side in (0, 1))
    counts = np.array([[len(x) // 4 for x in ids[i]] for i in full])
    ends = np.cumsum(counts, 0)
    found = overlaps(a_id, b_id, one.a_size, one.b_size)
    a, b = found.links
    per_doc = np.diff(np.searchsorted(a, np.concatenate([[0], ends[:, 0]])))
    numbers[full] = np.column_stack([counts, per_doc, per_doc])       # one A and one B token end at each common end
    for i, written in zip(full, written_groups(found, one, ends), strict=True):
        groups[i] = written
    return numbers, groups, a_id[a] * len(one.b_bytes) + b_id[b]


def _block(held: list[tuple], own: int) -> dict:
    """One row: documents, distinct pairs with their counts, and each link as a place among them, commonest first."""
    links = np.concatenate([x[-1] for x in held])
    pairs, place, n = np.unique(links, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order))
    packed = rank[place].view(np.uint8).reshape(-1, 4).T.tobytes()      # bytes of one weight together
    return {"block": own, "docs": [dict(zip(["doc_id", *FIELDS, "groups_sha256"], x[:-1], strict=True)) for x in held],
            "pairs": pairs[order], "n": n[order], "links": zstandard.compress(packed, 3)}


BLOCKS = f"block long, docs array<struct<doc_id long, {', '.join(f'{x} long' for x in FIELDS)}, groups_sha256 string>>, pairs array<long>, n array<long>, links binary"


def _blocks(byte_level: str, pieces: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, held, size, own = pair(byte_level, pieces), [], 0, 0
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"].astype("Int64")]
            edges = np.cumsum([len(t or "") for t in batch["text"]]) // CHARS
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(edges)) + 1):
                numbers, groups, links = aligned([batch["text"].iat[i] for i in part], one)
                for i, row, text, some in zip(part, numbers.tolist(), groups, np.split(links, np.cumsum(numbers[:, -1])[:-1]), strict=True):
                    held.append((ids[i], *row, "" if text is None else sha256(text.encode()).hexdigest(), some))
                    size += row[-1] + 1
                    if size >= BLOCK:
                        yield pd.DataFrame([_block(held, own)])
                        held, size, own = [], 0, own + 1
        if held:
            yield pd.DataFrame([_block(held, own)])
    return run


OUT = f"doc_id long, {', '.join(f'{x} long' for x in FIELDS)}, n_best long, count_sum long, groups_sha256 string"


def _scored(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    row = block.iloc[0]
    pairs = np.asarray(row["pairs"], np.int64)
    order = np.argsort(known["pair"].to_numpy(), kind="stable")
    at = order[np.searchsorted(known["pair"].to_numpy(), pairs, sorter=order)] if len(pairs) else np.empty(0, np.int64)
    total, best = known["total"].to_numpy()[at], known["best"].to_numpy()[at].astype(np.int64)
    raw = np.frombuffer(zstandard.decompress(row["links"]), np.uint8)
    place = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()
    docs = pd.DataFrame(list(row["docs"]))
    ends = np.cumsum(docs["n_links"].to_numpy(np.int64))
    for name, values in (("count_sum", total), ("n_best", best)):
        sums = np.concatenate([[0], np.cumsum(values[place])])
        docs[name] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
    return docs.assign(doc_id=docs["doc_id"].astype("Int64"))[[c.split()[0] for c in OUT.split(", ")]]


def alignment(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair has the highest count of its B id over all rows, ties included; count_sum adds up the pair counts
    of the links. Texts that are null or empty, or whose bytes either side does not give back, have zeros and an empty digest. Repeated rows
    count and are returned each; a null doc_id is kept. A text of any length is aligned whole. Empty tables give no rows. Other columns of
    docs are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = own.mapInPandas(_blocks(byte_level, pieces), BLOCKS).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks, "blocks")
    listed = blocks.select(F.col("block").alias("own"), F.explode(F.arrays_zip("pairs", "n")).alias("p")).select("own", F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    totals = materialize(listed.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    width = len(pair(byte_level, pieces).b_bytes)
    highest = materialize(totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("total").alias("highest")), "highest")
    known = totals.withColumn("b", F.col("pair") % width).join(highest.hint("merge"), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    known = listed.select("own", "pair").join(materialize(known, "known").hint("merge"), "pair").select("own", "pair", "total", "best")
    return blocks.select("block", "docs", "pairs", "links").groupBy("block").cogroup(known.groupBy("own")).applyInPandas(_scored, OUT)
