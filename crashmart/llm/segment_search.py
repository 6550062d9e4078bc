"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into equal segments, each with its mean and deviation. For two vectors the inner product of a segment of m components is
at most m (mean mean' + deviation deviation'), which is what the segment's lower-bound distance says of it; more and shorter segments
bound it tighter. For each query a block's rows are bounded from coarse to fine. The best bounds are scored exactly to raise the k-th best
score known, rows that cannot reach it go, and survivors of the finest level are scored exactly. Queries and rows meet in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, meet, usable

LEVELS = (2, 8, 32)
ROWS, QUERIES = 4096, 1024      # of a block


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, times the root of the segment's length; the last segment is filled with zeros."""
    width = -(-x.shape[1] // count)
    cut = np.pad(x, ((0, 0), (0, width * count - x.shape[1]))).reshape(len(x), count, width)
    return cut.mean(2) * width**0.5, cut.std(2) * width**0.5


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers."""
    small = np.abs(q).max(initial=0) * float(np.abs(x).max(initial=0)) * len(q) < 2**53
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if small else (x * q).sum(1)


def search(q: np.ndarray, x: np.ndarray, levels: list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]], one: int, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (and scores) of x that can be among the k best of query number `one`, all ties with the k-th included."""
    alive, least = allowed, -np.inf
    for (qm, qs), (xm, xs) in levels:
        top = xm[alive] @ qm[one] + xs[alive] @ qs[one]
        if len(alive) > k:
            seeds = alive[np.argpartition(-top, k - 1)[:k]]
            least = max(least, float(exact(q[one], x[seeds]).min()))
            slack = 1e-9 * (np.abs(top).max() + 1) + 1e-3
            alive = alive[top >= least - slack]
    scores = exact(q[one], x[alive])
    return alive[scores >= least], scores[scores >= least]


def _block(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            q, x = np.stack(left["v"]).astype(np.int64), np.stack(right["v"]).astype(np.int64)
            qf, xf = q.astype(np.float64), x.astype(np.float64)
            levels = [(segments(qf, min(n, q.shape[1])), segments(xf, min(n, q.shape[1]))) for n in LEVELS]
            ids = right["id"].to_numpy()
            for one, own in enumerate(left["id"].to_numpy()):
                rows, scores = search(q, x, levels, one, k, np.flatnonzero(ids != own))
                order = np.lexsort((ids[rows], -scores))[:k]
                out.append(pd.DataFrame({"query": own, "id": ids[rows][order], "score": scores[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []}).astype(np.int64)
    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, id, score) of the k highest inner products of each query with rows of another id; ties go to the lower id.

    Both frames have (id, v), v an array of whole numbers. Vectors meet vectors of their own length. Rows that repeat an id are each a
    candidate, and none is one of a query with that id; a repeated query id is searched once for each row.
    """
    left, right = (f.select("id", F.col("v").cast("array<long>").alias("v"), F.size("v").alias("length")) for f in (queries, rows))
    found = meet(left, right, "length", _block(k), "query long, id long, score long", QUERIES, ROWS)
    return best(found, k).select("query", "rank", "id", "score")


def whole_numbers(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """Usable vectors with floor(scale * x) for each component x."""
    return usable(rows).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
