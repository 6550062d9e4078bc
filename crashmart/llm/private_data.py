"""Personal data in text: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate spans: their shape, digit and letter counts, checksum, and what stands beside them. A window of text is
cut into tokens, a segmentation is a sequence of spans of at most `LONGEST` tokens with a type each and of single tokens outside, and its
weight is the exponential of the sum of its spans' scores. Training maximises the likelihood of segmentations that the base patterns
and plain `name = value` credentials give (a bounded sample of windows, a stated parameter); decoding finds the best segmentation by
dynamic programming. Spans of a base pattern always stay; spans of the field that overlap none of them are added.

Only spans that hold a digit or an at sign can be entities, so text further than `REACH` characters from any of these is outside at no
cost, and is not looked at twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract. A digit run can only start a match at its first digit.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
KINDS = ["email", "ip", "card", "phone", "account", "secret"]
BASE = KINDS[:4]

CREDENTIAL = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key)\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-]{16,})")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
RUN = re.compile(r"[\w+/=-]+")       # what no window cuts
LONGEST = 12        # tokens of a span
REACH = 40          # characters kept on either side of the marks
WINDOWS = 500       # windows that the field is trained on
ROUNDS = 12
SHOWN = 400         # characters of a training window

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, kind by kind: leftmost, not overlapping, failing ones dropped without a retry."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    if not MARK.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def windows(text: str) -> list[tuple[int, int]]:
    """The parts of a text that entities can lie in: around digits and at signs, widened to the ends of the runs of `RUN` they would cut."""
    out: list[list[int]] = []
    for m in MARK.finditer(text):
        if out and m.start() - out[-1][1] <= 2 * REACH:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    wide: list[tuple[int, int]] = []
    for a, b in out:
        a, b, least = max(0, a - REACH), min(len(text), b + REACH), wide[-1][1] if wide else 0
        if a > least and RUN.match(text[a]):
            while a > least and RUN.match(text[a - 1]):
                a -= 1
        if b < len(text) and RUN.match(text[b - 1]):
            b = m.end() if (m := RUN.match(text, b)) else b
        if wide and a <= least:
            wide[-1] = (wide[-1][0], max(b, least))
        else:
            wide.append((a, b))
    return wide


def shape(span: str) -> str:
    """Runs of digits, hexadecimal letters mixed with digits, letters; other characters stand for themselves; at most 16 runs are told apart."""
    runs = re.sub(r"[0-9]+", "0", re.sub(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}", "h", span[:512]))
    return re.sub(r"[^\W\d_h]+", "a", re.sub(r"(?:a|0){6,}", "m", runs))[:16]


def features(text: str, start: int, end: int) -> list[str]:
    span = text[start:end]
    digits = sum(map(span.count, "0123456789"))
    letters = sum(c.isalpha() for c in span) if digits < len(span) else 0
    bucket = "-".join(str(min(x, 20) if x < 20 else 20 if x < 32 else 32 if x < 64 else 64) for x in (digits,))
    left = text[:start].rstrip()[-1:] if start else "^"
    word = (re.findall(r"[A-Za-z]+(?=\W{0,4}$)", text[max(0, start - 16): start]) or ["-"])[-1].lower()
    plain = re.sub(r"[ -]", "", span)
    out = ["bias", f"shape {shape(span)}", f"digits {bucket}", f"letters {min(letters, 16) // 4}", f"left {left if not left.isalnum() else 'a'}",
           f"word {word}", f"right {'a' if text[end:end + 1].isalnum() else text[end:end + 1]}", f"first {'0' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}",
           f"glued {start > 0 and text[start - 1].isalnum()} {end < len(text) and text[end].isalnum()}"]
    if plain.isdigit() and plain.isascii():
        out.append(f"number {min(len(plain), 20)} {12 <= len(plain) <= 19 and luhn(plain)}")
    if span.isalnum() and digits and letters:
        out.append(f"mixed {len(span) >= 16} {len(set(span)) >= 8}")
    if "@" in span:
        out.append(f"at {'.' in span.split('@')[-1][1:]} {span.count('@')} {' ' in span}")
    if span.count(".") == 3 and plain.replace(".", "").isdigit():
        out.append(f"octets {all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in span.split('.'))}")
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first token, token after the last) of the spans that can be entities."""
    out = []
    marked = [bool(MARK.search(text, a, b)) for a, b in tokens]
    opens = [text[a].isalnum() or text[a] in "+(" for a, _ in tokens]
    for i in range(len(tokens)):
        if not opens[i]:
            continue
        some = False
        for j in range(i, min(len(tokens), i + LONGEST)):
            if j > i and tokens[j][0] - tokens[j - 1][1] > 1:
                break
            some |= marked[j]
            if some and text[tokens[j][1] - 1].isalnum():
                out.append((i, j + 1))
    return out


@dataclass(frozen=True)
class Field:
    """Weights of (feature) for each kind."""
    index: dict[str, int]
    weights: np.ndarray

    def scores(self, text: str, start: int, end: int) -> np.ndarray:
        known = [i for f in features(text, start, end) if (i := self.index.get(f)) is not None]
        return self.weights[known].sum(0) if known else np.full(len(KINDS), -1.0)

    def decode(self, text: str) -> list[Span]:
        """The best segmentation's entities."""
        tokens = [m.span() for m in TOKEN.finditer(text)]
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(tokens) + 1)]
        for i, j in candidates(text, tokens):
            s = self.scores(text, tokens[i][0], tokens[j - 1][1])
            kind = int(np.argmax(s))
            if s[kind] > 0:
                ends[j].append((i, float(s[kind]), kind))
        best, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            value, how = best[j - 1], None
            for i, s, kind in ends[j]:
                if best[i] + s > value:
                    value, how = best[i] + s, (i, kind)
            best.append(value)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((tokens[i][0], tokens[j - 1][1], KINDS[kind]))
                j = i
            else:
                j -= 1
        return out[::-1]


def taught_spans(text: str) -> list[Span]:
    """The segmentation a window is trained on: base spans, credentials, and card-like numbers without a checksum; the earlier wins."""
    found = base_spans(text)
    for m in CREDENTIAL.finditer(text):
        if MARK.search(m[1]):
            found.append((*m.span(1), "secret"))
    for m in CARD.finditer(text):
        if 12 <= len(m[0].replace(" ", "").replace("-", "")) <= 19:
            found.append((*m.span(), "account"))
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (KINDS.index(s[2]) == 4, s[0])):
        if all(s[1] <= o[0] or o[1] <= s[0] for o in out):
            out.append(s)
    return out


def train(texts: list[str], rounds: int = ROUNDS) -> Field:
    """Stochastic gradient ascent (per-weight step sizes) on the log-likelihood of the taught segmentations."""
    index: dict[str, int] = {}
    cases = []
    for text in sorted(set(texts)):
        tokens = [m.span() for m in TOKEN.finditer(text)]
        gold = {(a, b): KINDS.index(k) for a, b, k in taught_spans(text)}
        spans = candidates(text, tokens)
        if spans:
            cases.append((len(tokens), [(i, j, [index.setdefault(f, len(index)) for f in features(text, tokens[i][0], tokens[j - 1][1])],
                                         gold.get((tokens[i][0], tokens[j - 1][1]))) for i, j in spans]))
    weights, seen = np.zeros((len(index), len(KINDS))), np.full((len(index), len(KINDS)), 1e-2)
    for _ in range(rounds):
        for n, spans in cases:
            scores = [weights[f].sum(0) for *_, f, _ in spans]
            mass = np.logaddexp.reduce(np.array(scores), axis=1)
            starts: list[list[int]] = [[] for _ in range(n + 1)]
            ends: list[list[int]] = [[] for _ in range(n + 1)]
            for k, (i, j, *_) in enumerate(spans):
                starts[i].append(k)
                ends[j].append(k)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[spans[k][0]] + mass[k] for k in ends[j])])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[spans[k][1]] + mass[k] for k in starts[i])])
            for k, (i, j, f, kind) in enumerate(spans):
                p = np.exp(np.minimum(0, ahead[i] + behind[j] + scores[k] - ahead[n]))
                gradient = (np.arange(len(KINDS)) == kind) - p if kind is not None else -p
                if np.abs(gradient).max() > 1e-3:
                    seen[f] += gradient**2
                    weights[f] += 0.5 * gradient / np.sqrt(seen[f])
    return Field(index, weights)


def _training_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(hashlib.md5(w.encode()).hexdigest(), w) for t in batch["text"] for a, b in windows(t) for w in [t[a: min(b, a + SHOWN)]]]
        yield pd.DataFrame(out, columns=["order", "shown"])


def fit(docs: DataFrame, text: str = "text", most: int = WINDOWS) -> Field:
    """The field, trained on the `most` distinct windows of docs that come first by MD5. No window: nothing is added to the base spans."""
    source = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    rows = source.mapInPandas(_training_windows, "order string, shown string").distinct().orderBy("order").limit(most).collect()
    return train([r["shown"] for r in rows])


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a whole text, ordered."""
    text = text or ""
    base = base_spans(text)
    taken, added = sorted(base), []
    for a, b in windows(text):
        for s, e, kind in field.decode(text[a:b]):
            added.append((a + s, a + e, kind))
    out, at, reach = list(base), 0, 0
    for s in sorted(added):
        while at < len(taken) and taken[at][0] < s[1]:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s[0]:
            out.append(s)
    return ordered(base), ordered(out)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def private_data(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points. Null texts count as empty and have none; null doc_ids and repeated
    rows keep rows of their own; other columns are ignored."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find(t, field) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, **{
                name: [[{"kind": k, "start": a, "end": b} for a, b, k in f[i]] for f in found] for i, name in enumerate(("base", "spans"))}})
    kind = "array<struct<kind:string,start:int,end:int>>"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInPandas(run, f"doc_id long, base {kind}, spans {kind}")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str | None, field: Field) -> str | None:
    """The text with each stretch of spans replaced by the kind of its first span in angle brackets."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text, field)[1]:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with the spans of `text` masked; null texts stay null, all rows and columns stay."""
    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, field))
    return docs.withColumn(text, hide(F.col(text).cast("string")))
