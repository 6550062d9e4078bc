"""Importance resampling towards a target distribution, on hashed features of words.

Words come from the tokenizers library: an untrained regex split over the ASCII-lowered text, which returns words with their offsets. A
feature is a window over 1 to `longest` consecutive offset pairs, its words joined by one space; its bucket is the CRC-32 of its bytes
modulo `buckets`. Both texts and target are one histogram over the buckets; a bucket's gain is the logarithm of its smoothed share in the
target over its share in the texts, in thousandths, and a document's weight is the sum over its features. A Gumbel draw from a hash of
seed and id is added, so that the highest scores are a sample without replacement in proportion to exp(weight / 1000).

The space separates words in any text, so a text is split into chunks at spaces, and a task splits each distinct chunk once. Buckets of
the features are written with the documents; the histogram has `buckets` rows, whatever the input, and goes through the driver.
Ranks come from a range partitioning that is written once, with a counter in each partition.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize, numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CACHED = 400_000          # distinct chunks that a task remembers
TEXTS = 256               # texts that are split at once
Span = tuple[int, int]


class Splitter:
    """Words of chunks and the buckets of their single-word features, remembered by chunk."""

    def __init__(self, buckets: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split, self.buckets = Split(Regex(WORD), "removed", invert=True), buckets
        self.spans: dict[str, tuple[Span, ...]] = {}
        self.marks: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Splits all new chunks as one string; offsets are turned back into those of each chunk."""
        if len(self.spans) > CACHED:
            self.spans.clear()
            self.marks.clear()
        new = [c for c in chunks if c not in self.spans]
        ends = np.cumsum([len(c) + 1 for c in new])
        found = self.split.pre_tokenize_str(" ".join(new))
        at = np.searchsorted(ends, [span[0] for _, span in found], side="right").tolist()
        hashes = [crc32(word.encode()) % self.buckets for word, _ in found]
        edges = np.searchsorted(at, np.arange(len(new) + 1)).tolist() if found else [0] * (len(new) + 1)
        packed, base = np.array(hashes, "<u4").tobytes(), [0, *ends.tolist()]
        for i, (chunk, (a, b)) in enumerate(zip(new, pairwise(edges), strict=True)):
            self.marks[chunk] = packed[4 * a: 4 * b]
            self.spans[chunk] = tuple((s - base[i], e - base[i]) for _, (s, e) in found[a:b])

    def features(self, texts: list[str | None], longest: int) -> list[tuple[int, bytes]]:
        """For each text the number of its words, and the buckets of all its windows as little-endian unsigned 32-bit numbers."""
        lowered = [lower_ascii(t or "") for t in texts]
        split = [t.split(" ") for t in lowered]
        self.learn({c for own in split for c in own})
        out = []
        for text, own in zip(lowered, split, strict=True):
            marks = b"".join(map(self.marks.__getitem__, own))
            words = len(marks) // 4
            if longest > 1:
                spans = list(self._placed(own))
                marks = b"".join([marks, *(self._windows(text, spans, n) for n in range(2, longest + 1))])
            out.append((words, marks))
        return out

    def _placed(self, chunks: list[str]) -> Iterator[Span]:
        at = 0
        for chunk in chunks:
            yield from ((at + s, at + e) for s, e in self.spans[chunk])
            at += len(chunk) + 1

    def _windows(self, text: str, spans: list[Span], n: int) -> bytes:
        words = [text[s:e] for s, e in spans]
        return np.array([crc32(" ".join(words[i: i + n]).encode()) % self.buckets for i in range(len(words) - n + 1)], "<u4").tobytes()


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "replace").lower().decode()


@lru_cache(maxsize=4)
def splitter(buckets: int) -> Splitter:
    return Splitter(buckets)


def _marked(buckets: int, longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at: at + TEXTS]
                found = splitter(buckets).features(part["text"].tolist(), longest)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_words": [n for n, _ in found], "n_features": [len(m) // 4 for _, m in found],
                                    "marks": [m for _, m in found]})
    return run


def _counted(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for marks in batch["marks"]:
                total += np.bincount(np.frombuffer(marks, "<u4"), minlength=buckets) if len(marks) > buckets else 0
            few = b"".join(m for m in batch["marks"] if len(m) <= buckets)
            total += np.bincount(np.frombuffer(few, "<u4"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})
    return run


def _weighed(gains: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = np.array(gains, np.int64)
        for batch in batches:
            weights = [int(gain[np.frombuffer(m, "<u4")].sum()) for m in batch["marks"]]
            yield batch.drop(columns="marks").assign(doc_id=batch["doc_id"].astype("Int64"), weight=weights)
    return run


def marked(docs: DataFrame, buckets: int, longest: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, marks (the bucket of every feature, repeats kept) for each row; a null text has no words."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInPandas(_marked(buckets, longest), "doc_id long, n_words long, n_features long, marks binary")


def histogram(marks: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket: counted in every task, summed in Spark, `buckets` numbers for the driver."""
    rows = marks.select("marks").mapInPandas(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = [0] * buckets
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def gains(own: list[int], target: list[int]) -> list[int]:
    """Logarithm of smoothed target share over smoothed own share, in thousandths, rounded down."""
    buckets, all_own, all_target = len(own), sum(own), sum(target)
    return [math.floor(1000 * math.log(float((t + 1) * (all_own + buckets)) / float((s + 1) * (all_target + buckets)))) for s, t in zip(own, target, strict=True)]


def importance(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, percent: int = 10, least: int = 20, seed: int = 2024,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank (1, 2, 3 ... of the drawn ones, null for the others).

    Drawn are `percent` of a hundred (rounded down) of the documents with at least `least` words, highest score first, ties to the smaller
    doc_id. target needs a column `text` alone. Null and empty texts have no features, weight 0, and are not drawn while `least` is above
    0. A null doc_id draws as the empty string and comes last among equals; repeated rows count and rank each for themselves. Empty
    tables give no rows; an empty target gives every bucket the same share. Other columns of either table are ignored.
    """
    rows = materialize(marked(docs, buckets, longest, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "features")
    goal = histogram(marked(target.select(F.lit(0).alias("doc_id"), F.col("text")), buckets, longest), buckets)
    gain = gains(histogram(rows, buckets), goal)
    weighed = rows.mapInPandas(_weighed(gain), "doc_id long, n_words long, n_features long, row long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + draw).alias("score"), (F.col("n_words") < least).alias("out"), "row"), "scores")
    wanted = percent * scored.where(~F.col("out")).count() // 100
    ranked = numbered(scored, [F.col("out").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()], "place")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= wanted, F.col("place")).alias("rank"))


def importance_sql(buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> str:
    """The same for single words, over documents and benchmark. CRC-32 runs over the bytes of each distinct word with its usual table."""
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with own as (select row_number() over () as row, doc_id, {words} as words from documents),
each as (select row, unnest(words) as word from own),
goal as (select unnest({words}) as word from benchmark),
crc_table as (select {table} as tab),
distinct_words as (select word, hex(encode(word)) as h from (select word from each union select word from goal)),
spelled as (select word, list_transform(range(1, length(h) // 2 + 1), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1)
            + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1) as bytes from distinct_words),
hashed as (select word, xor(list_reduce(list_prepend(4294967295::bigint, bytes::bigint[]), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % {buckets} as bucket
           from spelled, crc_table),
s as (select bucket, count(*) as n from each join hashed using (word) group by bucket),
t as (select bucket, count(*) as n from goal join hashed using (word) group by bucket),
gain as (select distinct bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((select count(*) from each) + {buckets}))::double
         / ((coalesce(s.n, 0) + 1) * ((select count(*) from goal) + {buckets}))::double))::bigint as gain
         from hashed left join s using (bucket) left join t using (bucket)),
weights as (select row, sum(gain)::bigint as weight from each join hashed using (word) join gain using (bucket) group by row),
scored as (select own.row, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint
           + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
           from own left join weights using (row)),
places as (select *, row_number() over (partition by n_features >= {least} order by score desc, doc_id nulls last, row) as place,
           count(*) over (partition by n_features >= {least}) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= {least} and place <= {percent} * n // 100 then place end as rank from places
"""
