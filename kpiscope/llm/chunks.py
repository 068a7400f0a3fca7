"""Exact chunk-wise tokenisation for byte-level BPE vocabularies.

The byte-level pre-tokeniser never lets a piece run over the place before a single space
(or line feed) that stands between two other characters: no piece holds a space after its
first character unless it is white space throughout. So a text may be cut there, and each
cut part encoded alone, with the same ids as the whole text. Natural text repeats its words,
so each worker encodes a part once and keeps its ids (bounded by ``CACHE_CHUNKS``).

Parts are held under keys: ``"word"`` stands for " word", ``"\\nword"`` for itself, and
``"\\rtext"`` for "text" as it is (the first part of a text, or one with other white space).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

#: Beyond so many parts (about 150 MB of Python objects) a worker keeps those it used often.
CACHE_CHUNKS = 600_000
_CUT = re.compile(r"(?<=\S)(?= \S)")

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def keys_of(text: str) -> list[str]:
    """The keys of a text's parts, in order."""
    if not text:
        return []
    if "\n\n" not in text and "\n " not in text and "\r" not in text:
        keys = text.replace("\n", " \n").split(" ")
        # As many parts as runs of other characters, none empty: no further white space.
        if len(keys) == len(text.split()) and "" not in keys and keys[-1] != "\n":
            keys[0] = "\r" + keys[0]
            return keys
    return ["\r" + part for part in _CUT.split(text)]


def text_of(key: str) -> str:
    first = key[:1]
    return key[1:] if first == "\r" else key if first == "\n" else " " + key


class _Index(dict):
    """Gives each new key the next number and remembers it as not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class ChunkEncoder:
    """Encodes texts through ``encode``, which gets keys and returns (ids, ids of each key)."""

    def __init__(self, encode: Encoder, most: int | None = None) -> None:
        self.encode = encode
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1024, np.int32)
        self.used = 0
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.hits = np.zeros(1024, np.int64)

    def _forget(self) -> None:
        """Keep the parts used at least four times; all go if those fill half the room."""
        n, hits = len(self.index), self.hits
        kept = np.flatnonzero(hits[:n] >= 4)
        if 2 * len(kept) > (self.most or CACHE_CHUNKS):
            self._clear()
            return
        keys, ids, starts, counts = list(self.index), self.ids, self.starts[kept], self.counts[kept]
        self._clear()
        for i in kept.tolist():
            self.index[keys[i]] = len(self.index)
        ends = np.cumsum(counts)
        self.used = int(ends[-1]) if len(ends) else 0
        self.ids = ids[np.repeat(starts - (ends - counts), counts) + np.arange(self.used)]
        self.starts, self.counts, self.hits = ends - counts, counts, hits[kept]
        for name in ("ids", "starts", "counts", "hits"):
            setattr(self, name, np.concatenate([getattr(self, name), np.zeros(1024, getattr(self, name).dtype)]))

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        ids, counts = self.encode(new)
        n, have = len(self.index), len(self.index) - len(new)
        while n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[have:n] = counts
        self.starts[have:n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        if len(self.index) > (self.most or CACHE_CHUNKS):
            self._forget()
        got, sizes = [], []
        look = self.index.__getitem__
        for text in texts:
            keys = keys_of(text)
            sizes.append(len(keys))
            got.append(np.fromiter(map(look, keys), np.int64, len(keys)))
        self._learn()
        at = np.concatenate(got) if got else np.zeros(0, np.int64)
        used = np.bincount(at, minlength=1)
        self.hits[: len(used)] += used
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        # The place of each id: its part's start, moved by its place within the part.
        place = np.repeat(self.starts[at] - (ends - counts), counts)
        place += np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return self.ids[place], np.diff(bounds)


def batches(texts: list[bytes], most: int = 1 << 22) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each, so that arrays stay small."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            out.append((start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out
