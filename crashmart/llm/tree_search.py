"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Largest inner product becomes smallest distance by one more component, the root of (largest squared norm - own squared norm), zero for
queries. The tree is fitted on a bounded sample (`SAMPLE` rows, those of lowest hashed id), every row is put into a leaf, and a query
visits leaves in the order of a priority queue over the distances to the centres of the branches it has not taken. How many leaves
are visited is calibrated: the fewest that hold the wanted share of the exact neighbours of `TRIALS` queries. Scores are exact.

Leaves are searched in rounds, each of some `STEP` times the rows of those before. A round sends only rows that come before the last of the
k + 1 best so far, some `STEP` times k of them: rows sent grow with the number of rounds, the logarithm of the rows searched, and not with
the pages visited. Where leaves are large, the first of them are themselves searched in growing random shares.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize
from .vectors import best, lowest_of_each, meet, usable

SAMPLE, BRANCHES, LEAF = 20_000, 8, 8
TRIALS, RECALL = 200, 0.97
FIRST, STEP = 8, 4              # leaves at least of the first round; growth from round to round
ROWS, QUERIES = 4096, 4096      # of a block
SLICE = 1024                    # queries scored at once against a leaf
WALKS = 256                     # queries of a task that walks the tree


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.empty(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.centres is None:
                out[rows] = node.leaf
                continue
            near = nearest(x[rows], node.centres)
            todo += [(child, rows[near == i]) for i, child in enumerate(node.children) if (near == i).any()]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves of a query, best bin first."""
        queue, out, turn = [(0.0, 0, self.root)], [], 0
        while queue and len(out) < most:
            node = heapq.heappop(queue)[2]
            while node.centres is not None:
                distance = ((node.centres - q) ** 2).sum(1)
                first = int(np.argmin(distance))
                for i, child in enumerate(node.children):
                    if i != first:
                        turn += 1
                        heapq.heappush(queue, (float(distance[i]), turn, child))
                node = node.children[first]
            out.append(node.leaf)
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def grow(x: np.ndarray) -> Tree:
    """k-means in `BRANCHES` again and again, until a node has `LEAF` rows of the sample or cannot be parted."""
    rng, count = np.random.Generator(np.random.PCG64(5)), 0

    def node(rows: np.ndarray) -> Node:
        nonlocal count
        own, near = x[rows], None
        if len(rows) > LEAF:
            centres = own[rng.choice(len(rows), BRANCHES, replace=False)]
            for _ in range(12):
                near = nearest(own, centres)
                centres = np.stack([own[near == i].mean(0) if (near == i).any() else centres[i] for i in range(BRANCHES)])
            near = nearest(own, centres)
        used = np.unique(near) if near is not None else []
        if len(used) < 2:
            count += 1
            return Node(leaf=count - 1)
        return Node(centres[used], [node(rows[near == i]) for i in used])

    root = node(np.arange(len(x)))
    return Tree(root, count)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, components added from the first to the last, so equal vectors score alike everywhere."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * x[:, i]
    return out


def _near_ties(scores: np.ndarray) -> np.ndarray:
    """What another order of additions may make of a score, at least."""
    return np.where(np.isfinite(scores), scores - 1e-9 * (np.abs(scores) + 1), scores)


def _best_of_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each query, and those level with them."""
    scores = q @ x.T
    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
    rows, cols = np.nonzero(scores >= _near_ties(least)[:, None])
    return pd.DataFrame({"query": q_ids[rows], "id": ids[cols], "score": products(q[rows], x[cols])})


def _ranks(query: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by query and then by order (the last counts most), and the place of each in its query, from 0."""
    at = np.lexsort((*order, query))
    new = np.flatnonzero(np.diff(query[at], prepend=-1))
    return at, np.arange(len(at)) - np.repeat(new, np.diff(new, append=len(at)))


def best_of_page(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query (id, v, leaves, least, least_id) among the rows (id, v, leaf) of its leaves.

    Rows that come after (least, least_id), the score and id of the last row that the query can still use, are left out.
    """
    leaf_order, wanted = np.argsort(right["leaf"].to_numpy(), kind="stable"), np.concatenate(left["leaves"].tolist())
    x, ids, leaf = np.stack(right["v"])[leaf_order], right["id"].to_numpy()[leaf_order], right["leaf"].to_numpy()[leaf_order]
    who, by_leaf = np.repeat(np.arange(len(left)), [len(v) for v in left["leaves"]]), np.argsort(wanted, kind="stable")
    who, wanted, q, bound = who[by_leaf], wanted[by_leaf], np.stack(left["v"]), left["least"].to_numpy()
    floor = _near_ties(bound)
    rows, cols, about = [], [], []
    for own in np.unique(leaf):
        (a, b), (c, d) = np.searchsorted(leaf, [own, own + 1]), np.searchsorted(wanted, [own, own + 1])
        for some in (who[n: min(n + SLICE, d)] for n in range(c, d, SLICE)):
            scores, least = q[some] @ x[a:b].T, floor[some]
            if b - a > k:
                least = np.maximum(least, _near_ties(np.partition(scores, b - a - k, axis=1)[:, b - a - k]))
            i, j = np.nonzero(scores >= least[:, None])
            rows.append(some[i])
            cols.append(a + j)
            about.append(scores[i, j])
    rows, cols, about = (np.concatenate([np.empty(0, t), *v]) for t, v in ((np.int64, rows), (np.int64, cols), (float, about)))
    at, place = _ranks(rows, -about)
    last = np.full(len(left), -np.inf)
    last[rows[at[place == k - 1]]] = about[at[place == k - 1]]
    fine = about >= _near_ties(last)[rows]
    rows, cols = rows[fine], cols[fine]
    score = products(q[rows], x[cols])
    fine = (score > bound[rows]) | (score == bound[rows]) & (ids[cols] <= left["least_id"].to_numpy()[rows])
    rows, cols, score = rows[fine], cols[fine], score[fine]
    at, place = _ranks(rows, ids[cols], -score)
    at = at[place < k]
    return pd.DataFrame({"query": left["id"].to_numpy()[rows[at]], "id": ids[cols[at]], "score": score[at]})


def _page(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})
        return best_of_page(left, right, k)
    return run


def rounds(first: int, visits: int, rows: float, k: int) -> list[tuple[int, int, int, int, int]]:
    """(since, until, low, high, shares): leaves since to until of a query's order, of their rows the shares low to high out of `shares`.

    Every row of the first `visits` leaves is in one round. `rows` is the size of the leaf that holds a row, in the mean over rows. A random
    share of the first leaves, 4 k to 4 k `STEP` rows or so, comes first; the rest of them and then the further leaves follow in steps.
    """
    depth = max(0, int(math.log(max(1.0, first * rows / (4 * k)), STEP)))
    steps = max(1, round(math.log(visits / first, STEP)))
    ends = sorted({round(first * (visits / first) ** (i / steps)) for i in range(steps + 1)})
    shares = [0, *(STEP**i for i in range(depth + 1))]
    return [(0, first, low, high, shares[-1]) for low, high in itertools.pairwise(shares)] + [(since, until, 0, 1, 1) for since, until in itertools.pairwise(ends)]


def _paged(first: int, last: int, per_page: int):
    """Queries with some of their leaves, in one row for each page of leaves."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, v, leaves in zip(batch["id"], batch["v"], batch["leaves"], strict=True):
                some = np.sort(leaves[first:last])
                turns = np.flatnonzero(np.diff(some // per_page)) + 1
                rows += [(id_, v, int(part[0]) // per_page, part) for part in np.split(some, turns) if len(part)]
            yield pd.DataFrame(rows, columns=["id", "v", "page", "leaves"]).astype({"id": "int64", "page": "int32"})
    return run


def nearest_by_tree(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score, scored): of each vector whose id `every` divides, the k found with largest inner product, itself left out.

    vectors has vec_id and embedding. Rows without an id, and null, empty, zero or non-finite vectors, take no part. Vectors of each
    length have a tree of their own and meet no others; a length without a query is not looked at. A repeated id is a candidate once for each distinct
    vector. Equal vectors are searched once: ties go to the lower id, so only the k + 1 lowest ids of a vector can be found. scored is
    the number of indexed rows whose product was taken for the query; other columns of vectors are ignored.
    """
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v"))
    asked = rows.where(F.col("id") % every == 0).select("n").distinct().orderBy("n").collect()      # one row for each length of a vector
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    return reduce(DataFrame.union, [_of_one_length(rows.where(F.col("n") == r["n"]).drop("n"), every, k, recall) for r in asked] or [empty])


def _of_one_length(rows: DataFrame, every: int, k: int, recall: float) -> DataFrame:
    keyed = rows.select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    kept = materialize(lowest_of_each(keyed, k + 1), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    total, longest = kept.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = np.array([r["v"] for r in kept.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()])
    lift = lambda x: np.concatenate([x, np.sqrt(np.maximum(0, longest - (x * x).sum(1)))[:, None]], 1)
    tree = grow(lift(sample))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                leaf = tree.place(lift(np.stack(batch["v"])))
                yield batch.assign(leaf=leaf, page=leaf // per_page)

    # Leaves beside each other in the tree share a page of some ROWS rows, and a query is sent once in a round to each page.
    per_page = max(1, tree.leaves * ROWS // total)
    index = materialize(kept.select("id", "v").mapInPandas(place, "id long, v array<double>, leaf int, page int"), "index")
    asked = keyed.where(F.col("id") % every == 0)
    # One search for each distinct vector asked for, named by its lowest id.
    classes = materialize(asked.groupBy("a", "b").agg(F.min("id").alias("id"), F.max("v").alias("v")), "asked")
    visits = _calibrated(index, classes, tree, k, recall)
    first = min(visits, max(FIRST, -(-4 * (k + 1) * tree.leaves // total)))      # leaves that hold four times the rows wanted, or more

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaves = [tree.visit(np.append(v, 0.0), visits) for v in batch["v"]]
            yield batch.assign(leaves=leaves, scored=np.array([sizes[some].sum() for some in leaves], np.int64))

    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():      # fewer rows than the sample has
        sizes[r["leaf"]] = r["count"]
    # Walking the tree is the work here, so the tasks are cut by the number of queries, not by their bytes.
    dealt = classes.select("id", "v").repartition(-(-classes.count() // WALKS), "id")
    ordered = materialize(dealt.mapInPandas(order, "id long, v array<double>, leaves array<int>, scored long"), "visits")

    top = None
    for since, until, low, high, shares in rounds(first, visits, (sizes**2.0).sum() / sizes.sum(), k + 1):
        paged = ordered.mapInPandas(_paged(since, until, per_page), "id long, v array<double>, page int, leaves array<int>")
        if top is None:
            paged = paged.withColumn("least", F.lit(float("-inf"))).withColumn("least_id", F.lit(2**63 - 1))
        else:
            last = top.where(F.col("rank") == k + 1).select(F.col("query").alias("id"), F.col("score").alias("last"), F.col("id").alias("last_id"))
            paged = (paged.join(last, "id", "left").withColumn("least", F.coalesce("last", F.lit(float("-inf"))))
                     .withColumn("least_id", F.coalesce("last_id", F.lit(2**63 - 1))).drop("last", "last_id"))
        share = F.pmod(F.xxhash64(F.lit("share"), "id"), F.lit(shares))
        found = meet(materialize(paged, "paged"), index.where((share >= low) & (share < high)), "page", _page(k + 1), "query long, id long, score double", QUERIES, ROWS)
        found = found if top is None else found.union(top.select("query", "id", "score"))
        top = materialize(best(found.distinct(), k + 1), "best")
    named = asked.join(classes.select("a", "b", F.col("id").alias("query")), ["a", "b"]).select(F.col("id").alias("query_id"), "query").distinct()
    mine = named.join(top.drop("rank"), "query").join(ordered.select(F.col("id").alias("query"), "scored"), "query").where("id <> query_id").select("query_id", "id", "score", "scored")
    return best(mine, k, "query_id").select("query_id", "rank", F.col("id").alias("vec_id"), "score", "scored")


def _calibrated(index: DataFrame, classes: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The number of leaves to visit: the fewest among whose rows are the wanted share of the exact k best of some queries."""
    trials = classes.orderBy(F.xxhash64("id"), "id").limit(TRIALS).select("id", "v").collect()
    if not trials:
        return 1
    q, q_ids = np.array([r["v"] for r in trials]), np.array([r["id"] for r in trials])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                leaf = dict(zip(batch["id"], batch["leaf"], strict=True))
                found = _best_of_block(q, q_ids, np.stack(batch["v"]), batch["id"].to_numpy(), k)
                yield found.assign(leaf=found["id"].map(leaf))

    truth = best(index.mapInPandas(exact, "query long, id long, score double, leaf int"), k).select("query", "leaf").collect()      # at most TRIALS * k rows
    orders = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(np.append(v, 0.0), tree.leaves))} for i, v in zip(q_ids, q, strict=True)}
    needed = np.sort([orders[r["query"]][r["leaf"]] for r in truth])
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1
