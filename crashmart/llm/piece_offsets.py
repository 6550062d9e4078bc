"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map (a double-array trie with its replacement strings),
and every normalised byte remembers the source byte it came from. Pieces are byte ranges of the normalised text, so each projects to a
byte range of the original. BPE merges run inside segments: a segment ends before every space symbol that follows another character
and around every line feed, which is exact for vocabularies in which no piece reaches over such a place (checked when a model is
loaded; otherwise a text is one segment). Segments repeat, so each task keeps those it has seen, up to `CACHED`.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED = 500_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6      # piece types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialised message: whole numbers, floats or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at: at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at: at + n])[0]
            at += n


class CharacterMap:
    """The compiled character map: the longest prefix of some bytes that has a replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4: 4 + size], "<u4").tolist()
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Number of bytes matched at a place, and what stands for them."""
        if not self.units:
            return None
        unit, found = self.units[0], None
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value: self.strings.index(b"\0", value)]
        return found


class Known(dict):
    """What segments become; those of moderate length are remembered."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, segment: str) -> tuple[str, bytes, str]:
        hit = self.encoder.segment(segment)
        if len(segment) <= 64:
            self[segment] = hit
        return hit


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[tuple[str, float, int]] = []
        spec: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 3:
                spec = dict(_fields(value))
            elif number == 2:
                trainer = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if trainer.get(3, 1) != 2 or any(kind == USER for *_, kind in self.pieces):
            raise ValueError("BPE models without user-defined symbols only")
        self.scores = {p: s for p, s, kind in self.pieces if kind in (NORMAL, UNUSED)}
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED)}
        self.bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, (*_, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.end = next((i for i, (p, *_) in enumerate(self.pieces) if p == "</s>"), None)
        # Pieces never reach over a pair of neighbours that no piece contains; stops and commas are mostly such places as well.
        met = {pair for p in self.scores for pair in pairwise(p)}
        crossing = any(b == SPACE != a or "\n" in (a, b) for a, b in met)
        marks = "".join(c for c in ".,;:!?" if not any(b == c and a.isalpha() for a, b in met) and not any(a == c and b.isalpha() for a, b in met))
        word = f"{SPACE}*[^\\W_]++(?![^{SPACE}\n{marks}])|" if marks else ""
        self.segments = re.compile(r"(?s).+" if crossing else f"{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.known = Known(self)

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its bytes (and its end) the source byte. None: each byte stands for itself, but for
        the prefix (no source) and space symbols (three bytes for the one of a space)."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        data, at, out = text.encode(), 0, []
        while at < len(data):
            hit = self.map.longest(data, at)
            if not hit:
                n = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                hit = n, data[at: at + n]
            out.append((hit[1], at))
            at += hit[0]
        if self.squeeze:
            while out and out[0][0] == b" ":
                out.pop(0)
            tail = len(data)
            while out and out[-1][0] == b" ":
                tail = out.pop()[1]
            out = [x for before, x in pairwise([(b"", 0), *out]) if not (x[0] == b" " and before[0].endswith(b" "))]
        else:
            tail = len(data)
        if not out:
            return "", np.zeros(1, np.int64)
        mark = SPACE.encode() if self.escape else b" "
        parts, source = ([mark], [np.full(len(mark), out[0][1])]) if self.prefix else ([], [])
        for new, at in out:
            new = new.replace(b" ", mark)
            parts.append(new)
            source.append(np.full(len(new), at))
        return b"".join(parts).decode("utf-8", "replace"), np.concatenate([*source, [tail]])

    def merge(self, segment: str) -> list[str]:
        """BPE: the best pair first, of equal ones the leftmost."""
        parts, scores = list(segment), self.scores
        if len(parts) > 64:
            return self._merge_long(parts)
        never = float("-inf")
        pairs = [scores.get(a + b, never) for a, b in pairwise(parts)]
        while pairs and (best := max(pairs)) != never:
            i = pairs.index(best)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = scores.get(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = scores.get(parts[i - 1] + parts[i], never)
        return parts

    def _merge_long(self, parts: list[str | None]) -> list[str]:
        """The same with a queue, for segments without a place to break."""
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if (score := self.scores.get(both)) is not None:
                heapq.heappush(queue, (-score, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != len(both):
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def segment(self, segment: str) -> tuple[str, bytes, str]:
        """Of a segment: its ids in decimal after a blank each, (normalised bytes, source bytes if unmapped) of each piece, and its surface."""
        ids, spans, surface = [], [], []
        for piece in self.merge(segment):
            number = self.ids.get(piece)
            if number is not None or not self.bytes_:
                ids.append(self.unknown if number is None else number)
                n = len(piece.encode())
                spans += [n, n - 2 * piece.count(SPACE)]
                surface.append(piece if number is not None else " ⁇ ")
            else:
                raw = piece.encode()
                ids += [self.bytes_[b] for b in raw]
                # A space symbol has one source byte; elsewhere each byte piece has its own.
                spans += [n for i in range(len(raw)) for n in (1, int(piece != SPACE or i == 0))]
                surface.append(piece)
        return " " + " ".join(map(str, ids)), array("i", spans).tobytes(), segment if self.bytes_ else "".join(surface)

    def encode(self, text: str | None) -> tuple[str, np.ndarray, np.ndarray, str]:
        """Ids in decimal (blank before each, end id included), begin and end source bytes of each piece but the end id, decoded text."""
        text = text or ""
        normal, source = self.normalise(text)
        if len(self.known) > CACHED:
            self.known.clear()
        found = list(map(self.known.__getitem__, self.segments.findall(normal)))
        ids, spans, surface = zip(*found, strict=True) if found else ((), (), ())
        sizes = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
        if source is None and SPACE in text:          # the symbol itself in a source text is three bytes long there
            source = self._plain_source(text)
        if source is None:
            ends = np.cumsum(sizes[:, 1], dtype=np.int64)
            begins = ends - sizes[:, 1]
            if self.prefix:                           # the prefix has no source byte
                begins, ends = np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)
        else:
            ends = np.cumsum(sizes[:, 0], dtype=np.int64)
            begins, ends = source[ends - sizes[:, 0]], source[ends]
        decoded = "".join(surface).replace(SPACE, " ")
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return "".join(ids) + f" {self.end}", begins, ends, decoded

    def _plain_source(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        times = np.where(raw == 32, 3, 1)
        out = np.repeat(np.arange(len(raw)), times)
        return np.concatenate([np.zeros(3 * self.prefix, np.int64), out, [len(raw)]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (end id last), begins and ends (source bytes of each id but the last), decoded. Null texts count as empty and have the
    end id alone; null doc_ids and repeated rows keep their rows; other columns are ignored."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = batch.iloc[at: at + 100]
                ids, begins, ends, decoded = zip(*map(encoder(model).encode, some["text"]), strict=True)
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").array, "ids": [np.array(i.split(), np.int32) for i in ids], "begins": begins, "ends": ends, "decoded": decoded})
    return _source(docs, doc_id, text).mapInPandas(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What `encode` finds, in short: doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_crc32 over all begins and ends (32-bit, little-endian)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids, begins, ends, decoded = encoder(model).encode(t)
                spans = np.stack([begins, ends], 1).astype("<i4").tobytes()
                rows.append((ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(spans)))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out
    return _source(docs, doc_id, text).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
