"""Benchmark decontamination with generalised suffix automata.

The normalised test items (A-Z lower-cased, words of letters, digits and other characters)
go into generalised suffix automata over word numbers. A document's words are streamed
through them; an automaton's state gives the longest suffix read so far that occurs in some
item. A window of ``window`` consecutive item words (or a whole shorter item) occurs where that
length reaches it; the words of occurring windows are hit.

Before streaming, numpy looks up each pair of neighbouring words in the items' pairs: a match
cannot go on where a pair occurs in no item, so only stretches of known pairs (or single known
words, where an item has one word) are streamed. Nothing is lost by this.

An automaton holds at most ``AUTOMATON_WORDS`` item words, as sorted numpy arrays; longer items are
split into pieces that overlap by a window less a word, so each window is in some piece. All
automata of a group of at most ``GROUP_WORDS`` words are read in one pass over the documents; a
larger benchmark takes several passes, each writing the ranges found so far beside the text, with
one group at the driver and the executors at a time. Coverage is judged and text cut once, after
the last pass, so results do not depend on either size.

Null texts have no words. Items without words have no window. Rows of equal item_id are one item
with several texts; null ids are one item too, which counts in ``n_items`` and has no place in the
hash. Equal documents each get their row. An empty benchmark hits nothing; an empty table gives no
rows. Very long texts and very long words are held one text at a time.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.common import materialise, require_columns, utf8

WINDOW = 10
AUTOMATON_WORDS, GROUP_WORDS = 250_000, 2_000_000
#: A word counts as one more for each so many bytes, so that a group is bounded in bytes as well.
WORD_BYTES = 32
#: Words are bytes other than separators: ASCII digits and letters and all of U+0080 and above.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z become a-z, separators become spaces.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
STATE_BITS = 24


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Builder:
    """A generalised suffix automaton while it grows: one dictionary of all steps, keyed by
    state and word number, and arrays of links and lengths."""

    def __init__(self) -> None:
        self.steps: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.words_from: list[list[int]] = [[]]  # the word numbers that lead on from a state

    def _state(self, length: int, link: int, source: int | None = None) -> int:
        new = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.words_from.append([])
        if source is not None:
            for w in self.words_from[source]:
                self._step(new, w, self.steps[(w << STATE_BITS) | source])
        return new

    def _step(self, state: int, w: int, target: int) -> None:
        key = (w << STATE_BITS) | state
        if key not in self.steps:
            self.words_from[state].append(w)
        self.steps[key] = target

    def extend(self, last: int, w: int) -> int:
        have = self.steps.get((w << STATE_BITS) | last)
        if have is not None:
            return have if self.length[have] == self.length[last] + 1 else self._split(last, have, w)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and (w << STATE_BITS) | p not in self.steps:
            self._step(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.steps[(w << STATE_BITS) | p]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = copy
        while p >= 0 and self.steps.get((w << STATE_BITS) | p) == q:
            self.steps[(w << STATE_BITS) | p] = copy
            p = self.link[p]
        return copy


@dataclass
class Automaton:
    """A finished automaton in arrays, with each window's items at the state that ends it."""

    keys: np.ndarray  # steps in order: word number << STATE_BITS | state
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    entry: np.ndarray  # for each state, its first entry, or that of the nearest state up its links that has any
    need: np.ndarray  # for each entry, the words that its window has
    after: np.ndarray  # for each entry, the next one, of a shorter window; -1 after the last
    items_from: np.ndarray
    items: np.ndarray
    pairs: np.ndarray
    least: int

    def __post_init__(self) -> None:
        bits = max(12, (16 * max(1, len(self.pairs))).bit_length())
        self.shift = 64 - bits
        self._seen: np.ndarray | None = None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_seen": None}

    @property
    def seen(self) -> np.ndarray:
        """A table of the pairs' slots, which most pairs of a text fail at once."""
        if self._seen is None:
            self._seen = np.zeros(1 << (64 - self.shift), bool)
            self._seen[self._slot(self.pairs)] = True
        return self._seen

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of word places in which a match of the least window may lie."""
        if len(ids) < self.least or not len(self.keys):
            return []
        known = ids > 0
        if self.least == 1:
            joined = known[:-1] & known[1:]
        else:
            keys = (ids[:-1] << 32) | ids[1:]
            joined = self.seen[self._slot(keys)]
            maybe = np.flatnonzero(joined)
            if len(maybe):
                at = np.searchsorted(self.pairs, keys[maybe])
                joined[maybe] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == keys[maybe] if len(self.pairs) else False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        runs = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        if self.least == 1:  # single known words too
            alone = known.copy()
            for a, b in runs:
                alone[a:b] = False
            runs = sorted(runs + [(i, i + 1) for i in np.flatnonzero(alone).tolist()])
        return [(a, b) for a, b in runs if b - a >= self.least]

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of hit word places, and the items with occurring windows."""
        runs = self.stretches(ids)
        if not runs:
            return [], set()
        ranges: list[tuple[int, int]] = []
        entries: set[int] = set()
        keys, targets, link, length = map(memoryview, (self.keys, self.targets, self.link, self.length))
        entry, need, after = map(memoryview, (self.entry, self.need, self.after))
        n = len(keys)
        for a, b in runs:
            state = size = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while True:
                    key = (w << STATE_BITS) | state
                    k = bisect_left(keys, key)
                    if k < n and keys[k] == key:
                        state, size = targets[k], size + 1
                        break
                    if not state:
                        size = 0
                        break
                    state = link[state]
                    size = length[state]
                e = entry[state] if size else -1
                while e >= 0:
                    if size >= need[e]:
                        entries.add(e)
                        start = i + 1 - need[e]
                        if ranges and start <= ranges[-1][1]:
                            ranges[-1] = (min(start, ranges[-1][0]), i + 1)
                        else:
                            ranges.append((start, i + 1))
                    e = after[e]
        items: set[int] = set()
        for e in entries:
            items.update(self.items[self.items_from[e] : self.items_from[e + 1]].tolist())
        return ranges, items


def freeze(pieces: Sequence[tuple[int, Sequence[int]]], window: int) -> Automaton:
    """The automaton of (item, word numbers) pieces."""
    b, pairs, least = Builder(), set(), window
    for _, ids in pieces:
        last = 0
        for w in ids:
            last = b.extend(last, w)
        pairs.update((x << 32) | y for x, y in zip(ids, ids[1:]))
        least = min(least, len(ids))
    keys = np.fromiter(b.steps.keys(), np.int64, len(b.steps))
    targets = np.fromiter(b.steps.values(), np.int32, len(b.steps))
    order = np.argsort(keys)
    steps, link, length = b.steps, np.array(b.link, np.int32), np.array(b.length, np.int32)
    ends: list[tuple[int, int, int]] = []  # state, window's size, item
    for item, ids in pieces:
        size, state = min(window, len(ids)), 0
        for i, w in enumerate(ids):
            # Follow the last ``size`` words only.
            state = steps[(w << STATE_BITS) | state]
            while length[link[state]] >= size:
                state = link[state]
            if i + 1 >= size:
                ends.append((int(state), -size, item))
    rows = np.unique(np.array(ends, np.int32).reshape(-1, 3), axis=0)
    heads = np.flatnonzero(np.append(True, np.any(rows[1:, :2] != rows[:-1, :2], axis=1))) if len(rows) else np.zeros(0, np.int64)
    at, need = rows[heads, 0], -rows[heads, 1]
    entry, after = np.full(len(length), -1, np.int32), np.full(len(heads), -1, np.int32)
    first = dict(zip(at[::-1].tolist(), range(len(at) - 1, -1, -1)))  # a state's longest window
    for s in np.argsort(length, kind="stable").tolist():
        up = entry[link[s]] if s else -1
        entry[s] = first.get(s, up)
        e = first.get(s)
        while e is not None:  # its own windows, then those up its links
            more = e + 1 < len(at) and at[e + 1] == s
            after[e] = e + 1 if more else up
            e = e + 1 if more else None
    return Automaton(
        keys[order], targets[order], link, length, entry, need.astype(np.int32), after, np.append(heads, len(rows)), rows[:, 2].copy(),
        np.array(sorted(pairs), np.int64), least,
    )


def merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, with overlapping and touching ones merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Group:
    """Automata that are read in one pass, over one numbering of words."""

    names: list[str | None]
    number: dict[bytes, int]
    automata: list[Automaton]

    def match(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        ranges, items = [], set()
        for a in self.automata:
            got, who = a.match(ids)
            ranges += got
            items.update(self.names[i] for i in who)
        return merged(ranges), items


def build(items: Sequence[tuple[object, bytes]], window: int, most: int = AUTOMATON_WORDS) -> Group:
    """The group of all the items; each automaton has at most ``most`` words and a window more."""
    names: dict[str | None, int] = {}
    number: dict[bytes, int] = {}
    automata, held, size = [], [], 0
    for name, text in items:
        words = words_of(text)
        k = names.setdefault(None if name is None else str(name), len(names))
        for i in range(0, max(1, len(words) - window + 1) if words else 0, most):
            piece = [number.setdefault(w, len(number) + 1) for w in words[i : i + most + window - 1]]
            if held and size + len(piece) > most:
                automata.append(freeze(held, window))
                held, size = [], 0
            held.append((k, piece))
            size += len(piece)
    if held:
        automata.append(freeze(held, window))
    return Group(list(names), number, automata)


def item_groups(benchmark: DataFrame, text: str, item_id: str, most: int, window: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items a group at a time, fetched partition by partition; one empty group if there are none.
    A longer item is cut at words, with a window less a word in both parts."""
    held, size, some = [], 0, False
    for row in benchmark.select(F.col(f"`{item_id}`").alias("i"), utf8(f"`{text}`").alias("t")).toLocalIterator():
        words = words_of(bytes(row["t"]))
        for i in range(0, max(1, len(words) - window + 1) if words else 0, most):
            part = words[i : i + most + window - 1]
            n = len(part) + sum(map(len, part)) // WORD_BYTES
            if held and size + n > most:
                yield held
                held, size = [], 0
            held.append((row["i"], b" ".join(part)))
            size, some = size + n, True
    if held or not some:
        yield held


Finish = Callable[[pa.RecordBatch, list[int], list[list[tuple[int, int]]], list[list[str | None]]], pa.RecordBatch]
_RANGE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_STATE = "hit array<struct<start:int,end:int>>, items array<string>"


def _passes(
    docs: DataFrame, benchmark: DataFrame, at: int, finish: Finish, schema: T.StructType,
    window: int, item_id: str, item_text: str, group_words: int, automaton_words: int,
) -> DataFrame:
    """``finish`` over each batch of ``docs`` (columns c0, c1, ...; the text is number ``at``),
    given each text's words, merged ranges and sorted items over all groups."""
    width, spark = len(docs.columns), docs.sparkSession
    between = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_STATE).fields])
    groups = item_groups(benchmark, item_text, item_id, group_words, window)
    items, more = next(groups), True
    while more:
        following = next(groups, None)
        more = following is not None
        sent = spark.sparkContext.broadcast(build(items, window, automaton_words))

        def run(parts: Iterator[pa.RecordBatch], sent=sent, last=not more) -> Iterator[pa.RecordBatch]:
            group = sent.value
            for part in parts:
                seen = part.num_columns > width
                old_hits = part.column(width).to_pylist() if seen else [[]] * part.num_rows
                old_items = part.column(width + 1).to_pylist() if seen else [[]] * part.num_rows
                n, hits, found = [], [], []
                for t, h, f in zip(part.column(at), old_hits, old_items):
                    t = t.as_py()
                    words = words_of(t.encode() if isinstance(t, str) else t or b"")
                    ranges, who = group.match(words)
                    n.append(len(words))
                    hits.append(merged([*ranges, *((r["start"], r["end"]) for r in h)]) if h else ranges)
                    who.update(f)
                    # Sorted as strings; a null id comes last.
                    found.append(sorted(w for w in who if w is not None) + [None] * (None in who))
                if last:
                    yield finish(pa.RecordBatch.from_arrays(part.columns[:width], names=part.schema.names[:width]), n, hits, found)
                else:
                    ranges = pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], pa.list_(_RANGE))
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], ranges, pa.array(found, pa.list_(pa.string()))], names=[f.name for f in between.fields])

        docs = docs.mapInArrow(run, between if more else schema)
        if more:
            docs = materialise(docs, "decontamination")
            sent.unpersist()
            items = following
    return docs


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
    item_id: str = "item_id", item_text: str = "text", group_words: int = GROUP_WORDS, automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """(doc_id, n_words, hit, items): hit is an array of merged (start, end) word ranges, items
    the ids (as strings, sorted) with occurring windows. A map over partitions for each group."""
    require_columns(docs, [text, doc_id])
    require_columns(benchmark, [item_text, item_id])
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(f"`{text}`").alias("raw"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("n_words", T.LongType()), *T.StructType.fromDDL(_STATE).fields])

    def finish(part: pa.RecordBatch, n, hits, found) -> pa.RecordBatch:
        ranges = pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], pa.list_(_RANGE))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), ranges, pa.array(found, pa.list_(pa.string()))], names=[f.name for f in schema.fields])

    return _passes(slim, benchmark, 1, finish, schema, window, item_id, item_text, group_words, automaton_words)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, the hash of the item ids, contaminated."""
    got = scan(docs, benchmark, window)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return got.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut(text: bytes, ranges: Sequence[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges and what stands between them. White space
    before a cut stays, that after it goes, so words do not run together."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
        # Punctuation that closes the removed passage goes with it.
        while at < len(text) and text[at : at + 1] in b".,;:!?":
            at += 1
        while at < len(text) and text[at : at + 1] in b" \n\t":
            at += 1
    out.append(text[at:])
    return b"".join(out)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", group_words: int = GROUP_WORDS, automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Remove test passages from the texts; the columns stay as they are.

    Spans of ``window`` or more matched words (or whole shorter items) are removed; documents
    with more than ``max_coverage`` of their words in such spans are dropped. Null texts and
    documents without matches are returned as they are. A map over partitions for each group.
    """
    require_columns(docs, [text])
    require_columns(benchmark, [item_text, item_id])
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def finish(part: pa.RecordBatch, n, hits, found) -> pa.RecordBatch:
        keep = [i for i, (k, h) in enumerate(zip(n, hits)) if sum(b - a for a, b in h) <= max_coverage * k]
        left = part.take(pa.array(keep, pa.int64()))
        texts = left.column(at).to_pylist()
        for j, i in enumerate(keep):
            if hits[i]:
                texts[j] = cut(texts[j].encode(), hits[i]).decode()
        cols = [pa.array(texts, part.schema.field(at).type) if i == at else left.column(i) for i in range(left.num_columns)]
        return pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return _passes(plain, benchmark, at, finish, plain.schema, window, item_id, item_text, group_words, automaton_words).toDF(*names)
