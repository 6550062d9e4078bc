"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join, links confirmed on full shingle sets.

A document's set holds its distinct runs of `words` words (A-Z lower-cased, words between ASCII white space); a text with fewer words
has one run, a text without words has none. The signature has `slots` MinHash values of 16 bits, and two sets of similarity s differ
in about (1 - s) of the slots; `WIDE` further values of 8 bits are not indexed but sharpen the test. The distance bound is the smallest one that a pair exactly at the threshold exceeds with a chance below
`MISS`. By the pigeonhole principle two signatures within the bound agree in some chunk but for `bound // chunks` slots; each chunk is
indexed with every choice of that many slots left out, so every pair within the bound shares a key.

Steps, all on shuffles (joins with the corpus are hinted to merge, so that plans and costs are of one kind at every size):
1. documents with equal sets become one node, so copies cost nothing afterwards;
2. each key links its nodes to the one of them that shares most keys; pairs within the bound are confirmed on the sets; components follow;
3. nodes of keys that hold more than one component are compared in full, in cells of bounded size, skipping pairs that are already
   connected; what is confirmed is added. No link between different components is lost, and no group's pairs are written out: a
   cell confirms on the sets at once, and gives no link between nodes that it has connected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, materialize, text_key

MISS = 1e-6      # chance that a pair exactly at the threshold lies beyond the distance bound
WIDE = 192       # further MinHash values of 8 bits; a pair must also be near over all values
CELL = 512       # nodes that one side of a comparison cell holds
CELL_SHINGLES = 1_000_000     # shingles of all its nodes
ODD = [np.uint64(2 * int(x) + 1) for x in np.random.Generator(np.random.PCG64(7)).integers(1, 2**62, 16)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs of a text; empty for null, empty and blank texts."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * ODD[i % 16] + h[i: len(h) - width + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def most_errors(threshold: float, slots: int) -> int:
    """The smallest number of differing slots that a pair at the threshold exceeds with a chance below MISS."""
    p, tail, bound = 1 - threshold, 0.0, slots
    while bound and tail + comb(slots, bound) * p**bound * (1 - p) ** (slots - bound) < MISS:
        tail += comb(slots, bound) * p**bound * (1 - p) ** (slots - bound)
        bound -= 1
    return bound


@lru_cache(maxsize=8)
def plan(threshold: float, slots: int) -> tuple[int, list[tuple[int, tuple[int, ...]]]]:
    """The distance bound of the indexed slots, and the index: (number, slots kept) of every key."""
    bound = most_errors(threshold, slots)
    chunks = bound // 2 + 1                       # leaves at most one error in some chunk
    keys = []
    for chunk in np.array_split(np.arange(slots), chunks):
        errors = min(bound // chunks, len(chunk) - 1)
        keys += [tuple(map(int, kept)) for kept in combinations(chunk, len(chunk) - errors)]
    return bound, list(enumerate(keys))


@dataclass(frozen=True)
class Near:
    """When two signatures are near: few enough of the indexed slots differ, and few enough of all slots."""
    slots: int
    percent: int

    @property
    def bounds(self) -> tuple[int, int]:
        return plan(self.percent / 100, self.slots)[0], most_errors(self.percent / 100, self.slots + WIDE)

    def read(self, signatures: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, 2 * self.slots + WIDE)
        return np.ascontiguousarray(raw[:, : 2 * self.slots]).view(np.uint16), raw[:, 2 * self.slots:]

    def differ(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        few, all_ = self.bounds
        narrow = (a[0] != b[0]).sum(1)
        return (narrow > few) | (narrow + (a[1] != b[1]).sum(1) > all_)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of bytes for each non-empty set: `slots` MinHash values of 16 bits, then WIDE of 8 bits."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    factors = np.random.Generator(np.random.PCG64(11)).integers(1, 2**31, (2, slots + WIDE)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out, work = np.empty((len(sets), slots + WIDE), np.uint16), np.empty_like(flat)
    for i in range(slots + WIDE):
        np.multiply(flat, factors[0, i], out=work)
        np.bitwise_xor(work, factors[1, i], out=work)
        out[:, i] = _mix(np.minimum.reduceat(work, starts).astype(np.uint64)) >> np.uint64(40)
    return np.concatenate([np.ascontiguousarray(out[:, :slots]).view(np.uint8), out[:, slots:].astype(np.uint8)], 1)


def index_keys(sig: np.ndarray, keys: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """One 64-bit key for each signature and each entry of the index."""
    wide = sig.astype(np.uint64)
    out = np.empty((len(sig), len(keys)), np.uint64)
    for number, kept in keys:
        h = np.full(len(sig), number + 1, np.uint64)
        for i in kept:
            h = _mix(h * ODD[0] + wide[:, i])
        out[:, number] = h
    return out.view(np.int64)


def _describe(words: int, slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at: at + 256]
                sets = [shingle_set(t, words) for t in part["text"]]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, slots)) if full else iter(())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "row_a": part["row_a"], "row_b": part["row_b"], "n": [len(s) for s in sets],
                                    "k": [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                                    "sig": [next(sig).tobytes() if len(s) else None for s in sets]})
    return run


def _keyed(slots: int, keys: list) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at: at + 2048]
                sig = Near(slots, 0).read(part["sig"])[0]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "ks": list(index_keys(sig, keys))})
    return run


def _within(near: Near):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[~near.differ(near.read(batch["sig_a"]), near.read(batch["sig_b"]))][["a", "b"]]
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [linked(x, y, percent) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch[np.array(good, bool)][["a", "b"]]
    return run


def linked(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def cell_pairs(cell: dict[str, np.ndarray], near: Near) -> np.ndarray:
    """Confirmed links of one comparison cell between nodes of different components. Only pairs with near signatures and sizes that can
    reach the threshold are looked at; what a confirmed link connects needs no further one here, so a cell gives fewer links than it
    has nodes. A pair is looked at under the first key it shares only, as every other cell would find it again."""
    left, right = np.flatnonzero(cell["side"] == 0), np.flatnonzero(cell["side"] == 1)
    sig, wide, comp, node, size, entry = cell["sig"], cell["wide"], cell["comp"], cell["node"], cell["n"], int(cell["entry"][0])
    keys, out, root = plan(near.percent / 100, near.slots)[1], [], {}
    for at in range(0, len(left), step := max(1, 65_536 // max(1, len(right)))):
        some = left[at: at + step]
        x, y = np.nonzero((comp[some][:, None] != comp[right])
                          & (100 * np.minimum(size[some][:, None], size[right]) >= near.percent * np.maximum(size[some][:, None], size[right])))
        x, y = some[x], right[y]
        good = ~near.differ((sig[x], wide[x]), (sig[y], wide[y]))
        x, y = x[good], y[good]
        same = sig[x] == sig[y]
        first = np.ones(len(x), bool)
        for _, kept in keys[:entry]:
            first &= ~same[:, list(kept)].all(1)
        for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
            a, b = (_root(root, int(comp[k])) for k in (i, j))
            if a != b and linked(cell["s"][i], cell["s"][j], near.percent):
                root[a] = b
                out.append(np.sort(node[[i, j]])[None])
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _root(parents: dict[int, int], x: int) -> int:
    while x in parents:
        x = parents[x]
    return x


def _cells(near: Near):
    """Rows come sorted by cell; a cell has at most some CELL rows on each side, and may go on in the next batch."""
    names = ["key", "i", "j", "side", "node", "comp", "n", "entry"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in _then_none(batches):
            if batch is not None and len(batch):
                new = {c: batch[c].to_numpy() for c in names} | dict(zip(("sig", "wide"), near.read(batch["sig"]), strict=True)) | {"s": batch["s"].to_numpy(object)}
                held = {c: np.concatenate([held[c], v]) for c, v in new.items()} if held else new
            if not held or not len(held["key"]):
                continue
            turn = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])) + 1
            edges = [0, *turn.tolist()] + ([len(held["key"])] if batch is None else [])
            found = [cell_pairs({c: v[a:b] for c, v in held.items()}, near) for a, b in pairwise(edges)]
            held = {c: v[edges[-1]:] for c, v in held.items()}
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def _then_none(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at: at + 64]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "s": [shingle_set(t, words).tobytes() for t in part["text"]]})
    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, slots: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, row_a, row_b, winner.

    component_id is the smallest doc_id of the rows connected with this one. (row_a, row_b) is the text_key of (doc_id, text), and
    winner marks the rows whose key is the one that stays of the component: smallest doc_id, then smallest key. Null texts count as
    empty; empty sets are linked with nothing, their component_id is their own doc_id and each stays. Rows with a null doc_id take
    part; they name a component only if it has no other ids, and then component_id is null. Repeated rows are copies, all winners or
    none. Other columns of docs are ignored.
    """
    keys, close = plan(percent / 100, slots)[1], Near(slots, percent)
    row = text_key(F.col("doc_id"), F.col("text"))
    source = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
              .select("doc_id", "text", row["a"].alias("row_a"), row["b"].alias("row_b")))
    rows = materialize(source.mapInPandas(_describe(words, slots), "doc_id long, row_a long, row_b long, n long, k binary, sig binary"), "sets")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_a", "row_b"))
    own = rows.where("k is not null").groupBy("k").agg(lead.alias("lead"), F.max("sig").alias("sig"), F.max("n").alias("n"))
    nodes = materialize(own.select(F.monotonically_increasing_id().alias("node"), "k", "lead", "sig", "n"), "nodes")

    keyed = nodes.select("node", "sig").mapInPandas(_keyed(slots, keys), "node long, ks array<long>").select("node", F.posexplode("ks").alias("entry", "key"))
    shared = materialize(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("members"))
                         .where("low < high").select("key", "members"), "shared")
    buckets = materialize(keyed.join(shared.hint("merge"), "key").select("key", "entry", "node", "members"), "buckets")
    # The text that copies were made from shares more keys than they do among themselves: it is tried first in each of its keys.
    known = materialize(buckets.groupBy("node").agg(F.sum("members").alias("known")), "known")
    top = materialize(buckets.join(known.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("known", "node")).alias("top")).select("key", F.col("top.node").alias("top")), "top")
    signed = nodes.select("node", "sig")
    tried = (buckets.join(top.hint("merge"), "key").where("top <> node").select(F.least("top", "node").alias("a"), F.greatest("top", "node").alias("b")).distinct())
    near = (tried.join(signed.toDF("a", "sig_a").hint("merge"), "a").join(signed.toDF("b", "sig_b").hint("merge"), "b")
            .mapInPandas(_within(close), "a long, b long"))
    links = _confirmed(source, nodes, materialize(near, "pairs"), words, percent)
    labels = materialize(components(nodes.select("node"), links), "components")

    # What the first links left apart although a key is shared: compared in full, whatever the size of the group.
    placed = buckets.join(labels.hint("merge"), "node")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    mixed = materialize(mixed.join(top.hint("merge"), "key"), "mixed")
    open_ = materialize(placed.join(mixed.hint("merge"), "key").select("key", "entry", "node", "members", "top", F.col("label").alias("comp")), "open")
    if open_.limit(1).count():
        rest = _rest(source, nodes, open_, words, percent, close)
        if rest.limit(1).count():
            labels = materialize(components(nodes.select("node"), links.union(rest)), "components")

    placed = nodes.join(labels, "node").select("k", "lead", "label")
    best = materialize(placed.groupBy("label").agg(F.min("lead").alias("best")), "best")
    fates = materialize(placed.join(best, "label").select("k", F.col("best.doc_id").alias("component_id"), F.col("best.row_a").alias("best_a"),
                                                          F.col("best.row_b").alias("best_b")), "fates")
    linked = rows.where("k is not null").join(fates.hint("merge"), "k").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "row_a", "row_b",
        ((F.col("row_a") == F.col("best_a")) & (F.col("row_b") == F.col("best_b"))).alias("winner"))
    empty = rows.where("k is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row_a", "row_b", F.lit(True).alias("winner"))
    return linked.union(empty)


def _rest(source: DataFrame, nodes: DataFrame, open_: DataFrame, words: int, percent: int, near: Near) -> DataFrame:
    """Confirmed links between different components among the nodes of the open keys.

    Nodes that open keys connect form a field; each key links its nodes to the node that shares most keys, so the links of a group of
    copies fall together. A field is compared as a whole where its square is no more than the squares of its keys (many keys with the
    same nodes), and key by key elsewhere (few shared keys); both find every pair that is near.
    """
    spokes = open_.where("top <> node").select(F.col("top").alias("a"), F.col("node").alias("b"))
    fields = materialize(components(open_.select("node").distinct(), spokes).toDF("node", "field"), "fields")
    per_key = open_.where("node = top").join(fields, "node").groupBy("field").agg(F.sum(F.col("members").cast("double") * F.col("members")).alias("by_key"))
    sizes = fields.groupBy("field").agg(F.count(F.lit(1)).alias("size"))
    ways = materialize(sizes.join(per_key, "field").select("field", (F.col("size").cast("double") * F.col("size") <= F.col("by_key")).alias("whole")), "ways")
    way = materialize(fields.join(ways, "field"), "way")
    sets = _node_sets(source, nodes, way.select("node"), words)

    whole = open_.select("node", "comp").distinct().join(way.where("whole").select("node", "field"), "node")
    parted = open_.join(way.where("not whole").select("node"), "node").select("key", "entry", "node", "comp")
    found = [_compared(group, nodes, sets, near) for group in (whole.select(F.col("field").alias("key"), F.lit(0).alias("entry"), "node", "comp"), parted)]
    return materialize(found[0].union(found[1]).distinct(), "links")


def _compared(members: DataFrame, nodes: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links among the members (key, entry, node, comp) of each key, in cells of bounded size."""
    sized = members.join(nodes.select("node", "sig", "n"), "node")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("blocks"))
    cells = _gridded(sized.join(materialize(blocks, "blocks").hint("merge"), "key")).join(sets.hint("merge"), "node")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_cells(near), "a long, b long")


def _gridded(members: DataFrame) -> DataFrame:
    """Rows of a group (key, blocks) in every cell that compares their block with another or with itself; side 0 meets side 1."""
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.select("key", "entry", "node", "comp", "sig", "n", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    sides = F.when(F.col("block") == F.col("with"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("block") < F.col("with"), 0).otherwise(1)))
    return spread.select("key", "entry", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "comp", "sig", "n", F.explode(sides).alias("side"))


def _node_sets(source: DataFrame, nodes: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(node, s): the full sets of some nodes, made again from the text of one row each."""
    wanted = materialize(nodes.join(needed, "node").select("node", F.col("lead.row_a").alias("row_a"), F.col("lead.row_b").alias("row_b")), "wanted")
    texts = source.join(wanted.hint("merge"), ["row_a", "row_b"]).select("node", "text")
    return materialize(texts.mapInPandas(_sets(words), "node long, s binary").groupBy("node").agg(F.first("s").alias("s")), "shingles")


def _confirmed(source: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Sets are made again from the texts, for nodes in some pair alone."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _node_sets(source, nodes, needed, words)
    both = pairs.join(sets.toDF("a", "set_a").hint("merge"), "a").join(sets.toDF("b", "set_b").hint("merge"), "b")
    return materialize(both.mapInPandas(_confirm(percent), "a long, b long"), "links")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the row of smallest doc_id stays, of repeated rows one; all columns stay."""
    row = text_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), row["a"].alias("row_a"), row["b"].alias("row_b"))
    stay = materialize(near_duplicates(docs, words, percent).where("winner").select("row_a", "row_b").distinct(), "stay")
    return keyed.join(stay.hint("merge"), ["row_a", "row_b"]).dropDuplicates(["row_a", "row_b"]).select("whole.*")
