"""Token ids of whole texts from a tokenizer file that drops white space, encoded chunk by chunk.

Space, line feed, tab and carriage return end every pre-token of such a tokenizer and never take part in a composition, so the ids of
a text are the ids of the chunks between them, in order. A chunk of Latin letters, with at most one full stop or comma after it, is lower-cased and
its letters and its mark are pre-tokens of their own (such letters are composed already), so the tokenizer's model alone is asked for
it; other chunks go through the whole tokenizer. Chunks repeat; each task keeps the ids of the chunks it has seen, and forgets
all of them when `CACHED` is reached.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

CACHED = 500_000
LONG = 64      # longer chunks are encoded each time
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,]?)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Chunks(dict):
    """Ids of chunks, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {"": b""}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            plain = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(plain)])
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONG:
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        parts = PLAIN.fullmatch(chunk.lower())
        if parts:
            ids = self.word(parts[1]) + self.word(parts[2])
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        if len(self) > CACHED or len(self.words) > CACHED:
            self.clear()
            self.words.clear()
            self[""] = self.words[""] = b""
        return [b"".join(map(self.__getitem__, (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)
