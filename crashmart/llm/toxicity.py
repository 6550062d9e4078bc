"""Toxic passages: maximum-scoring segments of token log-odds, aggregated by their extreme-value significance.

1. Token counts of toxic and clean labelled rows give log-odds with an informative Dirichlet prior: the words' shares of all labelled text,
   as strong as `PRIOR` of that text. Log-odds are shrunk by their own uncertainty, so words that chance explains weigh nothing. Words that pass
   are counted again, once in a text and once for each pair of neighbours they stand between there, so that copies, repeated passages and
   the favourite words of one text count once.
2. Every token scores its log-odds, if these outweigh the drift, minus `DRIFT`. The linear-time scan for all maximal scoring segments finds the toxic passages.
3. In clean text the best segment of n tokens follows an extreme-value law with lambda (the root of E exp(lambda s) = 1 over clean
   tokens) and K (from the clean labelled rows' segments). A document's evidence is the sum of lambda S - log(K n) over its segments
   for which that is positive, that is, of which fewer than one is expected by chance.
4. A logistic curve over log(1 + evidence), fitted on the labelled rows, turns evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import materialize

PRIOR = 0.05          # strength of the prior as a share of all labelled tokens
CERTAIN = 3.0         # standard deviations within which log-odds count as chance
SHARE = 1e-6          # rarer words carry no weight, so at most 1 / SHARE words do
DRIFT = 0.5
LEAST = 2.0           # segments below this score are not kept
BINS = 100            # evidence is tallied in tenths up to this
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Weights:
    words: dict[int, float]
    rate: float           # lambda


@dataclass(frozen=True)
class Calibration:
    log_k: float
    base: float
    slope: float


def word_keys(text: str | None) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) >> 1 for w in WORD.findall((text or "").lower())]


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) in order; each candidate points to the last one that begins lower."""
    total = np.cumsum(scores)
    low, high, first, end, back = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        l, r, start = float(total[i] - scores[i]), float(total[i]), i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= l:
                j = back[j]
            if j < 0 or high[j] >= r:
                break
            l, start = low[j], first[j]
            del low[j:], high[j:], first[j:], end[j:], back[j:]
        low.append(l), high.append(r), first.append(start), end.append(i + 1), back.append(j)
    return [(h - l, a, b) for l, h, a, b in zip(low, high, first, end, strict=True)]


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for toxic, rows in batch.groupby("toxic"):
            counts: Counter[int] = Counter()
            for text in rows["text"]:
                counts.update(word_keys(text))
            yield pd.DataFrame({"word": np.fromiter(counts.keys(), np.int64, len(counts)), "bad": np.fromiter(counts.values(), np.int64, len(counts)) * int(toxic),
                                "good": np.fromiter(counts.values(), np.int64, len(counts)) * (1 - int(toxic))})


def _contexts(words: set[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                keys = [0, *word_keys(text), 0]
                own: dict[int, int] = {}
                for i, k in enumerate(keys[1:-1]):
                    if k in words:
                        context = xxhash.xxh3_64_intdigest(b"%d %d" % (keys[i], keys[i + 2])) >> 1
                        own[k] = min(context, own.get(k, context))
                seen.update((k, context, int(toxic)) for k, context in own.items())
            yield pd.DataFrame(list(seen), columns=["word", "context", "toxic"], dtype="int64")
    return run


def _weighed(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """Words (word, bad, good, share) with their shrunk log-odds and their chance in clean text; words that cannot outweigh the drift go."""
    strength = PRIOR * (n1 + n0)
    prior = F.col("share") * strength
    one, two = F.col("bad") + prior, F.col("good") + prior
    odds = F.log(one / (n1 + strength - one)) - F.log(two / (n0 + strength - two))
    shrunk = odds * F.greatest(F.lit(0.0), 1 - CERTAIN**2 / F.greatest(odds**2 / (1 / one + 1 / two), F.lit(1e-12)))
    return counts.where(F.col("share") >= SHARE).select("word", "share", shrunk.alias("weight"), (two / (n0 + strength)).alias("clean")).where(F.col("weight") > DRIFT)


def learn(docs: DataFrame, labels: DataFrame, teach: Column) -> Weights:
    """Word weights from the rows of docs for which `teach` holds and labels has 0 or 1 (a doc_id labelled twice counts as toxic if either is)."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = materialize(docs.where(teach).select("doc_id", "text").join(marks.hint("merge"), "doc_id").select("text", "toxic"), "taught")
    counts = materialize(taught.mapInPandas(_tally, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    n1, n0 = (counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first())
    if not n1 or not n0:
        return Weights({}, 1.0)
    first = materialize(_weighed(counts.withColumn("share", (F.col("bad") + F.col("good")) / F.lit(float(n1 + n0))), n1, n0), "weights")
    words = {r["word"] for r in first.select("word").collect()}          # at most 1 / SHARE words
    seen = taught.mapInPandas(_contexts(words), "word long, context long, toxic int").distinct()
    again = seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    rows = _weighed(again.join(first.select("word", "share"), "word"), n1, n0).collect()
    words = {r["word"]: r["weight"] for r in rows}
    steps, chance = np.array([w - DRIFT for w in words.values()] + [-DRIFT]), np.array([r["clean"] for r in rows])
    chance = np.append(chance, max(1e-12, 1 - chance.sum()))
    lo, hi = 1e-6, 1.0
    grow = lambda x: float((chance * np.exp(np.minimum(x * steps, 700))).sum()) - 1
    while grow(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if grow(mid) < 0 else (lo, mid)
    return Weights(words, lo)


def passages(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, n_tokens, segments: array of (score, start, end), character places in the whole text; written out.

    Null texts count as empty and have no tokens; null doc_ids and repeated rows keep rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.words)      # at most 1 / SHARE words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            n, found = [], []
            for text in batch["text"]:
                keys = word_keys(text)
                scores = np.array([known.get(k, 0.0) for k in keys]) - DRIFT
                segments = [s for s in maximal_segments(scores) if s[0] >= LEAST] if len(keys) else []
                if segments:
                    # Lower-casing may change lengths; places come from the words of the text as it is.
                    places = [m.span() for m in WORD.finditer(text)]
                    if len(places) != len(keys):
                        places = [m.span() for m in WORD.finditer(text.lower())]
                    segments = [{"score": s, "start": places[a][0], "end": places[b - 1][1]} for s, a, b in segments]
                n.append(len(keys))
                found.append(segments)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, "n_tokens": n, "segments": found})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(source.mapInPandas(run, "doc_id long, n_tokens long, segments array<struct<score:double,start:int,end:int>>"), "passages")


def _evidence(rate: float, log_k: float) -> Column:
    room = F.lit(log_k) + F.log(F.greatest(F.col("n_tokens"), F.lit(1)))
    return F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), rate * s["score"] - room))


def calibrate(found: DataFrame, labels: DataFrame, teach: Column, rate: float) -> Calibration:
    """K from the clean labelled rows, then the logistic curve; both from small tallies over all labelled rows of `teach`."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = materialize(found.where(teach).join(marks.hint("merge"), "doc_id").select("toxic", "n_tokens", "segments"), "taught")
    clean = taught.where("toxic = 0").agg(F.sum("n_tokens").alias("n"), F.sum(F.size("segments")).alias("k")).first()
    # Segments of at least LEAST in clean text: K n exp(-rate LEAST) are expected. One more counts for those never seen.
    log_k = math.log(((clean["k"] or 0) + 1) / ((clean["n"] or 0) + 1)) + rate * LEAST
    tenth = F.least(F.round(_evidence(rate, log_k) * 10), F.lit(10.0 * BINS))
    tally = taught.select(tenth.alias("x"), "toxic").groupBy("x").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()     # at most 10 * BINS rows
    x = np.log1p(np.array([r["x"] for r in tally]) / 10)
    bad, n = np.array([r["bad"] for r in tally], float), np.array([r["n"] for r in tally], float)
    base, slope = math.log((bad.sum() + 0.5) / (n.sum() - bad.sum() + 0.5)), 0.0
    for _ in range(50 if len(tally) > 1 else 0):
        p = 1 / (1 + np.exp(-(base + slope * x)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([(bad - n * p).sum() - 1e-3 * base, ((bad - n * p) * x).sum() - 1e-3 * slope])
        bend = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(bend, gradient), -1, 1)
        base, slope = base + step[0], slope + step[1]
    return Calibration(log_k, float(base), max(0.0, float(slope)))


def score(found: DataFrame, rate: float, curve: Calibration) -> DataFrame:
    """doc_id, score (0 to 1), n_passages (significant ones), evidence."""
    room = F.lit(curve.log_k) + F.log(F.greatest(F.col("n_tokens"), F.lit(1)))
    evidence = _evidence(rate, curve.log_k)
    return found.select("doc_id", (1 / (1 + F.exp(-(curve.base + curve.slope * F.log1p(evidence))))).alias("score"),
                        F.size(F.filter("segments", lambda s: rate * s["score"] > room)).cast("long").alias("n_passages"), evidence.alias("evidence"))


def taught_rows() -> Column:
    """Rows that labels may be learned from: crc32 of the doc_id as text leaves 0 or 2 on division by 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn, scan, calibrate, score: doc_id, score, n_passages, evidence for each row of docs. Without labels of both kinds nothing has weight."""
    weights = learn(docs, labels, taught_rows())
    found = passages(docs, weights)
    return score(found, weights.rate, calibrate(found, labels, taught_rows(), weights.rate))
