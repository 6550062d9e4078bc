"""Best-fit packing of token pieces into fixed-length sequences by linear grouping.

Only the number of pieces of each length reaches the driver (at most `capacity` rows). The plan is made on those counts:

1. large lengths, sorted, fall into groups of equal cardinality and are rounded up to the largest of their group;
2. how often to use each configuration of the few rounded sizes is optimised by column generation; whole uses are kept;
3. actual lengths take the places of the rounded ones, group by group, which gives runs of sequences with equal free space;
4. small lengths and the large ones that whole uses leave over, largest first, go where they fit best, on whole runs at once; what fits
   nowhere opens new sequences.

Rounding up leaves some of the substituted sequences loose. Their pieces can go back to step 4, so steps 3 and 4 are done for several bounds
on the free space of a sequence that is kept (`LOOSE`), and for each number of groups in `GROUPS`; the plan with the fewest sequences is
taken, the first of equal ones, and a plan that needs no more than the tokens fill ends the search. With every sequence sent back the plan is
best fit of all lengths, so there are never more sequences than that has.

The plan says which ranks of a length go to which sequence, and its size depends on the lengths, not on the number of pieces. Each
piece then finds its place from its rank among the pieces of its length; ranks come from counts of written partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialize
from .word_tokens import chunks

END = 1
GROUPS = (48, 96)
LOOSE = (1, 1 / 64, 1 / 256, 1 / 1024, 0, -1)      # shares of the capacity
GAIN = 1e-4      # a configuration has to be worth that much more than one sequence


def _price(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worthy configuration that fits: for each size, how many."""
    best, taken = np.zeros(capacity + 1), []
    for size, w in zip(sizes, worth, strict=True):
        new, count = best.copy(), np.zeros(capacity + 1, np.int32)
        for c in range(1, capacity // size + 1) if w > 1e-12 else ():
            gain = best[: capacity + 1 - c * size] + c * w
            better = gain > new[c * size:] + 1e-12
            new[c * size:][better] = gain[better]
            count[c * size:][better] = c
        best = new
        taken.append(count)
    left, out = capacity, np.zeros(len(sizes), int)
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = taken[i][left]
        left -= out[i] * sizes[i]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with their whole numbers of uses, which together cover the demand for each size but for what rounding down leaves."""
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * len(sizes)):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, new = _price(sizes, duals, capacity)
        if value <= 1 + GAIN:
            break
        uses, change = np.linalg.solve(basis, need), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = new
    uses, left, out = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(int), np.array(demand), []
    for column, n in zip(basis.T.astype(int), uses, strict=True):
        n = int(min([n, *(left[i] // column[i] for i in np.flatnonzero(column))]))
        if n > 0:
            out.append((column, n))
            left = left - n * column
    return out


Entry = tuple[int, int, int, int, int, int]      # length, first rank, pieces, first sequence, pieces of it in a sequence, offset


def make_plan(counts: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS) -> tuple[list[Entry], int]:
    """Entries, and the number of sequences."""
    best, least = None, -(-sum(length * n for length, n in counts.items()) // capacity)
    for some in groups:
        bins, uses = grouped(counts, capacity, some)
        for loose in LOOSE:
            found = substituted(counts, capacity, bins, uses, int(loose * capacity))
            best = found if best is None or found[1] < best[1] else best
            if best[1] <= least:
                return best
    return best or ([], 0)


def grouped(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[list[list[int]]], list[tuple[np.ndarray, int]]]:
    """Groups of the large lengths, each a list of [length, pieces] from the largest on, and the configurations of their largest lengths."""
    large = sorted((length for length in counts if capacity // 8 < length < capacity and counts[length]), reverse=True)
    size, bins, seen = -(-sum(counts[length] for length in large) // groups), [], 0
    for length in large:
        n = counts[length]
        while n:
            if seen % size == 0:
                bins.append([])
            took = min(n, size - seen % size)
            bins[-1].append([length, took])
            seen, n = seen + took, n - took
    merged: list[list[list[int]]] = []
    for b in bins:
        if merged and merged[-1][0][0] == b[0][0]:
            merged[-1] += b
        else:
            merged.append(b)
    return merged, configurations([b[0][0] for b in merged], [sum(n for _, n in b) for b in merged], capacity) if merged else []


def substituted(counts: dict[int, int], capacity: int, bins: list[list[list[int]]], uses: list[tuple[np.ndarray, int]], loose: int) -> tuple[list[Entry], int]:
    """Actual lengths in the places of the configurations, sequences with more than `loose` free left out, then best fit of all others."""
    entries: list[Entry] = []
    used, runs, sequences = Counter(), [], 0      # runs: (free, first sequence, sequences)

    def place(length: int, n: int, base: int, each: int, offset: int) -> None:
        entries.append((length, used[length], n, base, each, offset))
        used[length] += n

    whole = counts.get(capacity, 0)
    if whole:
        place(capacity, whole, 0, 1, 0)
        sequences = whole
    supply = [[list(some) for some in reversed(b)] for b in bins]
    for column, times in uses:
        filled: list[list[list[int]]] = []      # for each slot, the lengths its sequences get, in order
        for i in (i for i in np.flatnonzero(column) for _ in range(column[i])):
            want, got = times, []
            while want and supply[i]:
                length, n = supply[i][-1]
                took = min(n, want)
                got.append([length, took])
                want -= took
                supply[i][-1][1] -= took
                if not supply[i][-1][1]:
                    supply[i].pop()
            filled.append(got)
        done = 0
        while done < times:
            heads = [s[0] for s in filled if s]
            step = min([times - done, *(h[1] for h in heads)])
            kept, offset = capacity - sum(h[0] for h in heads) <= loose, 0
            for head in heads:
                if kept:
                    place(head[0], step, sequences, 1, offset)
                offset += head[0]
                head[1] -= step
            filled = [s[1:] if s and not s[0][1] else s for s in filled]
            done += step
            if kept:
                insort(runs, (capacity - offset, sequences, step))
                sequences += step
    for length in sorted((x for x in counts if counts[x] and x < capacity), reverse=True):
        n = counts[length] - used[length]
        while n:
            at = bisect_left(runs, (length, -1, -1))
            if at == len(runs):
                fresh = -(-n // (capacity // length))
                runs.append((capacity, sequences, fresh))
                sequences += fresh
            free, base, many = runs.pop(at)
            each = free // length
            full = min(many, n // each)
            if full:
                place(length, full * each, base, each, capacity - free)
                insort(runs, (free - each * length, base, full))
                n -= full * each
            rest = min(n, each) if full < many else 0
            if rest:
                place(length, rest, base + full, rest, capacity - free)
                insort(runs, (free - rest * length, base + full, 1))
                n -= rest
            if many > full + bool(rest):
                insort(runs, (free, base + full + bool(rest), many - full - bool(rest)))
    return entries, sequences


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        encoder, end = chunks(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                some, rows = batch.iloc[at: at + 500], []
                for doc, ids in zip(some["doc_id"], encoder.encode(some["text"].tolist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start: 4 * (start + capacity)]
                        rows.append((doc, piece, start, len(cut) // 4, zlib.crc32(cut), part, seen[len(cut) // 4]))
                        seen[len(cut) // 4] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens of every whole text, its end id included, written out: doc_id, piece, start, length, ids_crc32,
    and part, nth: the piece's place among the pieces of its length in its partition. A null text counts as empty and has the end id
    alone; null doc_ids and repeated rows keep rows of their own."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cut = source.mapInPandas(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
    return materialize(cut, "pieces")


def pack(cut: DataFrame, capacity: int = 4096, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """The rows of `cut` (as `pieces` returns them) with sequence_id and offset; sequences have no gaps and no overlap."""
    tallies = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(tallies.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "ranks")
    counts = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}     # at most `capacity` rows
    entries, _ = make_plan(counts, capacity, groups)
    table = np.array(sorted(entries), np.int64).reshape(-1, 6)
    starts = table[:, 0] * 2**48 + table[:, 1]      # ordered by length, then first rank

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), (batch["first"] + batch["nth"]).to_numpy()
            hit = table[np.searchsorted(starts, length * 2**48 + rank, "right") - 1]
            inside = rank - hit[:, 1]
            out = batch[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "Int64"})
            yield out.assign(sequence_id=hit[:, 3] + inside // hit[:, 4], offset=hit[:, 5] + inside % hit[:, 4] * length)

    ranked = cut.join(first.select("length", "part", "first").hint("merge"), ["length", "part"])      # grows with the partitions
    return ranked.mapInPandas(places, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
