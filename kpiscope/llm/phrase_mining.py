"""Collocations: phrases of two to five words by how far they stand above chance, in each language.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs
into words. Once, documents become blocks of one language: distinct words, and the text as their
numbers with 0 between pieces. All further passes read blocks.

1. Words are counted exactly. Blocks are written again with frequent words only (``least`` times or more),
   as no frequent phrase holds another.
2. Sketches. Level by level each task counts the hashed phrases of k words whose two parts of k - 1 words may
   be frequent, in two rows of saturating counters; rows are added up by segments, and one bit a counter
   that reaches the threshold goes to the next level's tasks. As counters are upper bounds, no frequent phrase is missed.
3. Counting, in one pass. Each task compiles the phrases of its own blocks whose bounds hold at every level into
   pyahocorasick automata, at most ``SHARD`` in one: a delimiter stands at both ends of each word, in patterns
   and texts, and another character, in no pattern, between pieces and for words of no candidate. It scans its blocks
   with them, counting overlapping matches, and sends packed sums by bucket of hash. Only the exact totals count further.
4. Scores, in decimals: of all cuts of a phrase the lowest of floor(1000 a n / (l r)). Phrases inside one of
   a word more that is as frequent go (any longer one implies such a one), and the best of each language stay.

Sketch widths grow with the number of words up to ``MOST_BITS`` bits a row, which bounds what is
broadcast (``2 ** MOST_BITS / 8`` bytes a row); beyond it bounds are looser, so there are more candidates, and
the same results. Besides these bits the driver holds the hashes of the frequent words, 8 bytes each; no list of phrases.

Null texts are empty, a null language is ``und``. Words count with repeats; copies of documents count each time. Ties
go to the phrase first in UTF-8 order. Texts of any length are read in slices. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.llm.common import materialise, require_columns, utf8
from kpiscope.llm.cross_align import _pack, _spread, _squeeze, _unpack

UND = "und"
#: A block of one language closes at so many text bytes; all open ones of a task hold at most OPEN_BYTES.
BLOCK_BYTES, OPEN_BYTES, SLICE = 4 << 20, 16 << 20, 1 << 20
LEAST_BITS, MOST_BITS = 16, 26
#: Counters of a segment, the unit in which sketches are added up; so many parts of one are added at a time.
SEGMENT, FAN = 1 << 17, 64
#: So many words of a language (frequent ones, and what stands for the others) are scanned together.
GATHERED = 1 << 21
#: Candidates of one automaton; their words fit into Unicode's characters.
SHARD = 150_000
#: The first ranking of a language's phrases is done in so many parts.
PARTS = 8
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n\n ")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BLOCK = "block long, lang string, words array<string>, counts array<long>, codes binary"


def tokens(raw: bytes) -> Iterator[pa.Array]:
    """The words, with ``\\n`` between pieces, in slices."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):  # to the next end of a word
            space = raw.find(b" ", end)
            end = len(raw) if space < 0 else space
        words = pc.split_pattern(pa.array([raw[at:end].translate(_MAP).replace(b"\n", b" \n ")], pa.binary()), " ").values
        yield words.filter(pc.greater(pc.binary_length(words), 0))
        at = end


def _planes(codes: np.ndarray) -> bytes:
    """Word numbers in one compressed value, the bytes of each order together."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(codes, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _codes(raw: bytes) -> np.ndarray:
    import zstandard

    b = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(b.reshape(4, -1).T).reshape(-1).view("<i4")


def _one(words: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)


class _Open:
    """A block that is being filled."""

    def __init__(self) -> None:
        self.words = pa.array([b"\n"], pa.binary())
        self.codes: list[np.ndarray] = []
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        self.waiting += [raw, b"\n"]
        self.size += len(raw) + 64

    def numbered(self) -> np.ndarray:
        """The texts so far as numbers of ``words``."""
        for some in batched(tokens(b"".join(self.waiting)), 8):
            coded = pa.chunked_array(some, pa.binary()).combine_chunks().dictionary_encode()
            own = coded.dictionary
            self.words = pa.concat_arrays([self.words, own.filter(pc.invert(pc.is_in(own, self.words)))])
            self.codes.append(pc.index_in(own, self.words).to_numpy()[coded.indices.to_numpy()])
        return np.concatenate(self.codes)


def blocks_of(docs: DataFrame, lang: str, text: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, held, total = TaskContext.get().partitionId() << 32, {}, 0

        def close(name: str) -> pa.RecordBatch:
            nonlocal no, total
            b = held.pop(name)
            total, no = total - b.size, no + 1
            codes = b.numbered()
            counts = np.bincount(codes, minlength=len(b.words))
            row = [pa.array([no], pa.int64()), pa.array([name], pa.string()), _one(b.words.cast(pa.string())), _one(pa.array(counts, pa.int64())), pa.array([_planes(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["block", "lang", "words", "counts", "codes"])

        for part in parts:
            for name, raw in zip(part.column(0).to_pylist(), part.column(1)):
                b = held.setdefault(name, _Open())
                before = b.size
                b.add(raw.as_buffer().to_pybytes())
                total += b.size - before
                if b.size >= BLOCK_BYTES:
                    yield close(name)
                elif total >= OPEN_BYTES:
                    yield close(max(held, key=lambda x: held[x].size))
        for name in list(held):
            yield close(name)

    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UND)).alias("lang"), utf8(f"`{text}`").alias("raw"))
    return slim.mapInArrow(run, BLOCK)


def hashes_of(words: DataFrame) -> np.ndarray:
    """The sorted hashes of a table (lang, word), 8 bytes a word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary())], names=["hashes"])

    got = words.select(F.xxhash64("lang", "word")).mapInArrow(run, "hashes binary").collect()
    return np.unique(np.frombuffer(b"".join(r["hashes"] for r in got), np.int64))


def frequent_only(blocks: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Blocks of the words of ``frequent`` and their hashes; all others stand as the 0 between pieces, runs of it as one.

    A word that shares a frequent one's hash stays, and adds candidates only.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(frequent)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part in parts:
            for lang, words, hashes, codes in zip(*part.columns) if len(known) else ():
                hashes = hashes.values.to_numpy()
                ok = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                ok[0] = True
                kept = np.flatnonzero(ok)
                number = np.zeros(len(hashes), np.int32)
                number[kept] = np.arange(len(kept))
                codes = number[_codes(codes.as_py())]
                stays = codes > 0
                stays[1:] |= stays[:-1]
                row = [pa.array([lang.as_py()], pa.string()), _one(words.values.take(pa.array(kept))), pa.array([hashes[kept].tobytes()], pa.binary()), pa.array([_planes(codes[stays])], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["lang", "words", "hashes", "codes"])

    hashed = blocks.select("lang", "words", F.transform("words", lambda w: F.xxhash64("lang", w)).alias("hashes"), "codes")
    return hashed.mapInArrow(run, "lang string, words array<string>, hashes binary, codes binary")


def buckets(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A counter of each of the two rows."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.uint32), (hashes >> np.uint64(64 - bits)).astype(np.uint32)


class Bounds:
    """Which counters of each level, from phrases of two words on, reach the threshold, as bits."""

    def __init__(self, levels: list[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> None:
        self.levels = levels

    def may(self, k: int, hashes: np.ndarray) -> np.ndarray:
        bits, rows = self.levels[k - 2]
        ok = np.ones(len(hashes), bool)
        for at, row in zip(buckets(hashes, bits), rows):
            ok &= (row[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return ok

    def walk(self, single: np.ndarray, codes: np.ndarray, upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, hashes) of the phrases of k words, up to ``upto`` of them, whose parts may be
        frequent; where the level's own bounds are known, those that may be frequent themselves."""
        places = np.flatnonzero(codes)
        h = single[codes[places]]
        for k in range(2, upto + 1):
            both = np.flatnonzero(places[1:] == places[:-1] + 1)
            places = places[both]
            with np.errstate(over="ignore"):
                h = h[both] * _STEP + single[codes[places + k - 1]] + np.uint64(k)
                h ^= h >> np.uint64(31)
                h *= _MIX
                h ^= h >> np.uint64(29)
            if k - 2 < len(self.levels):
                sure = self.may(k, h)
                places, h = places[sure], h[sure]
            yield k, places, h


class _Counters:
    """Two rows of saturating counters."""

    def __init__(self, bits: int, most: int) -> None:
        self.bits, self.most = bits, most
        self.rows = [np.zeros(1 << bits, np.uint8 if most < 256 else np.uint32) for _ in range(2)]

    def add(self, hashes: np.ndarray) -> None:
        for row, at in zip(self.rows, buckets(hashes, self.bits)):
            at, n = np.unique(at, return_counts=True)
            row[at] = np.minimum(row[at].astype(np.int64) + n, self.most)

    def segments(self) -> Iterator[tuple[int, int, bytes]]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for r, row in enumerate(self.rows):
            for s in range(0, len(row), SEGMENT):
                piece = row[s : s + SEGMENT]
                if piece.any():
                    yield r, s // SEGMENT, pack(piece.tobytes())


SKETCH = "part long, row int, segment int, counters binary"


def sketch(blocks: DataFrame, level: int, bits: int, least: int, known: list) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The level's bits: which counters reach ``least``. At most 2 x 2 ** bits / 8 bytes come to the driver."""
    import zstandard

    sent = blocks.sparkSession.sparkContext.broadcast(known)
    kind, wide = (np.uint8, np.uint16) if least < 256 else (np.uint32, np.uint64)
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["part", "row", "segment", "counters"]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, counters = Bounds(sent.value), _Counters(bits, least)
        for part in parts:
            for row in part.to_pylist():
                for k, _, hashes in bounds.walk(np.frombuffer(row["hashes"], np.uint64), _codes(row["codes"]), level):
                    if k == level:
                        counters.add(hashes)
        no = TaskContext.get().partitionId()
        for r, s, raw in counters.segments():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((no, r, s, raw), types)], names=names)

    def merge(table: pa.Table, last: bool) -> pa.Table:
        total = None
        for raw in table["counters"]:
            piece = np.frombuffer(zstandard.decompress(raw.as_py()), kind)
            total = piece.astype(wide) if total is None else np.minimum(np.add(total, piece, out=total), least, out=total)
        out = np.packbits(total >= least, bitorder="little").tobytes() if last else zstandard.compress(total.astype(kind).tobytes(), 1)
        return pa.table([pa.array([v], t) for v, t in zip((table["part"][0].as_py(), table["row"][0].as_py(), table["segment"][0].as_py(), out), types)], names=names)

    # A task's counters cost the same for few words and many.
    slim = blocks.select("hashes", "codes").coalesce(max(1, -(-blocks.rdd.getNumPartitions() // 2)))
    parts, got = slim.rdd.getNumPartitions(), slim.mapInArrow(count, SKETCH)
    while parts > FAN:
        got = got.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "row", "segment").applyInArrow(lambda t: merge(t, False), SKETCH)
        parts = -(-parts // FAN)
    got = got.groupBy("row", "segment").applyInArrow(lambda t: merge(t, True), SKETCH)
    rows = tuple(np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(2))
    for r in got.select("row", "segment", "counters").collect():
        piece = np.frombuffer(r["counters"], np.uint8)
        rows[r["row"]][r["segment"] * (SEGMENT >> 3) :][: len(piece)] = piece
    sent.unpersist()
    return bits, rows


def distinct_grams(codes: np.ndarray, places: np.ndarray, hashes: np.ndarray, k: int) -> Iterator[tuple[list[int], int]]:
    """The different phrases at the places and how often each occurs; equal hashes are compared word by word."""
    _, first, back, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    grams = codes[places[:, None] + np.arange(k)]
    own = grams[first]
    odd = (grams != own[back]).any(1)
    if odd.any():
        n = n - np.bincount(back[odd], minlength=len(n))
        more, m = np.unique(grams[odd], axis=0, return_counts=True)
        yield from zip(more.tolist(), m.tolist())
    yield from zip(own.tolist(), n.tolist())


#: Stands at both ends of each word; between pieces and for other words; the first digit's character.
DELIMITER, GUARD, FIRST = "\x01", "\x02", 3


def character(i: int) -> int:
    """The i-th code point; surrogates are left out."""
    c = i + FIRST
    return c if c < 0xD800 else c + 0x800


class Scanner:
    """An automaton of delimited phrases, over texts that are given as word numbers.

    A word is three characters, its number's digits: pyahocorasick looks at a node's children one by one,
    and with a character a word the node after the first delimiter had one for each first word.
    """

    def __init__(self, phrases: list[str]) -> None:
        import ahocorasick

        self.size = len(phrases)
        self.points: dict[str, int] = {}  # words from 1
        for p in phrases:
            for w in p.split(" "):
                self.points.setdefault(w, len(self.points) + 1)
        base = 2
        while base**3 <= len(self.points):
            base += 1
        digits = np.arange(len(self.points) + 1)[:, None] // base ** np.arange(2, -1, -1) % base
        self.digits = np.array([character(d) for d in range(base)], "<u4")[digits]
        coded = [DELIMITER + "".join(map(chr, d)) for d in self.digits.tolist()]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        pairs: list[int] = []
        for n, p in enumerate(phrases):
            numbers = [self.points[w] for w in p.split(" ")]
            self.machine.add_word("".join([coded[w] for w in numbers]) + DELIMITER, n)
            pairs += [x << 32 | y for x, y in zip(numbers, numbers[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))
        if phrases:
            self.machine.make_automaton()

    def counts(self, words: list[str], codes: np.ndarray) -> np.ndarray:
        """How often each phrase occurs, overlapping occurrences included. Only runs of words that
        stand next to each other in some phrase are scanned."""
        none = np.zeros(self.size, np.int64)
        if not self.size or len(codes) < 2:
            return none
        look = np.array([self.points.get(w, 0) for w in words], np.int64)
        look[0] = 0
        points = look[codes]
        at = np.flatnonzero((points[:-1] > 0) & (points[1:] > 0))
        pairs = points[at] << 32 | points[at + 1]
        found = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        near = at[self.pairs[found] == pairs]
        if not len(near):
            return none
        # Words of such pairs in order, and a guard wherever one does not go on from the one before.
        kept = np.zeros(len(points), bool)
        kept[near] = kept[near + 1] = True
        begins = kept.copy()
        begins[near + 1] = False
        place = np.flatnonzero(kept)
        new = begins[place]
        slot = np.arange(len(place)) * 4 + 2 * np.cumsum(new)  # of the delimiter before the word
        text = np.full(int(slot[-1]) + 5, ord(DELIMITER), "<u4")
        for d in range(3):
            text[slot + d + 1] = self.digits[points[place], d]
        text[slot[new] - 1] = ord(GUARD)
        hits = map(itemgetter(1), self.machine.iter(text.tobytes().decode("utf-32-le")))
        return np.bincount(np.fromiter(hits, np.int64), minlength=self.size)


class _Gathered:
    """Blocks of one language under one numbering."""

    def __init__(self) -> None:
        self.words, self.hashes, self.codes, self.size = {"\n": 0}, [np.zeros(1, np.uint64)], [], 0

    def add(self, words: list[str], hashes: np.ndarray, codes: np.ndarray) -> None:
        before = len(self.words)
        number = np.fromiter((self.words.setdefault(w, len(self.words)) for w in words), np.int32, len(words))
        new = number >= before  # a block's words are distinct
        self.hashes.append(hashes[new])
        self.codes += [number[codes], np.zeros(1, np.int32)]
        self.size += len(codes) + 1

    def counts(self, bounds: Bounds, longest: int, shard: int) -> Iterator[tuple[list[str], np.ndarray]]:
        """The phrases whose bounds hold and how often an automaton meets each, ``shard`` phrases at a time."""
        words, codes, single, phrases = list(self.words), np.concatenate(self.codes), np.concatenate(self.hashes), []
        for k, places, hashes in bounds.walk(single, codes, longest):
            phrases += [" ".join([words[c] for c in gram]) for gram, n in distinct_grams(codes, places, hashes, k) if n]
        phrases.sort()  # nodes that are met together lie together, a fifth less time than in the order of hashes
        for at in range(0, len(phrases), shard):
            some = phrases[at : at + shard]
            yield some, Scanner(some).counts(words, codes)


SUMS = "bucket int, lang string, phrases binary, counts binary"


def count_exactly(blocks: DataFrame, known: list, longest: int, least: int, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, a) of the phrases that occur at least ``least`` times.

    Each task compiles the phrases of its own blocks whose bounds hold, ``GATHERED`` words of a language together, and
    scans these blocks, so there is one pass however many phrases there are. Tasks send packed sums by
    bucket of hash, and a bucket's sums are added up in one stream.
    """
    parts = max(1, blocks.rdd.getNumPartitions())
    sent = blocks.sparkSession.sparkContext.broadcast(known)
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
    names = ["bucket", "lang", "phrases", "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bounds, held = Bounds(sent.value), {}

        def deal(lang: str) -> Iterator[pa.RecordBatch]:
            for phrases, n in held.pop(lang).counts(bounds, longest, shard):
                where = np.fromiter((xxhash.xxh3_64_intdigest(p.encode()) % parts for p in phrases), np.int64, len(phrases))
                order = np.argsort(where, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else ():
                    row = (int(where[some[0]]), lang, _pack([phrases[i] for i in some.tolist()]), _squeeze(n[some]))
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                mine = held.setdefault(row["lang"], _Gathered())
                mine.add(row["words"], np.frombuffer(row["hashes"], np.uint64), _codes(row["codes"]))
                if mine.size >= GATHERED:
                    yield from deal(row["lang"])
                elif sum(x.size for x in held.values()) >= GATHERED:
                    yield from deal(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield from deal(lang)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def reached() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                there = [(p, n) for p, n in counts.items() if n >= least]
                columns = [pa.array([lang] * len(there), pa.string()), pa.array([p for p, _ in there], pa.string()), pa.array([n for _, n in there], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    yield from reached()
                    now, sums = row["bucket"], {}
                counts = sums.setdefault(row["lang"], {})
                for p, n in zip(_unpack(row["phrases"]), _spread(row["counts"]).tolist()):
                    counts[p] = counts.get(p, 0) + n
        yield from reached()

    sums = blocks.select("lang", "words", "hashes", "codes").mapInArrow(scan, SUMS)
    return sums.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "lang string, phrase string, a long")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest cut of each phrase of ``phrases`` (lang, phrase, a)."""
    known = phrases.unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("f").alias("a")))
    w = F.split("phrase", " ", -1)
    cuts = phrases.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    joined = lambda part: F.array_join(part, " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("left"), joined(F.slice("w", F.col("k") + 1, F.size("w"))).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", big("a") * big("n") * F.lit(1000).cast("decimal(4,0)"), big("l") * big("r")).cast("long")
    got = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang").withColumn("score", score)
    least = got.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    return least.select("lang", "phrase", *[f"x.{c}" for c in ("a", "l", "r", "n", "score")])


def outermost(phrases: DataFrame, ranked: DataFrame) -> DataFrame:
    """``ranked`` without phrases inside one of a word more that occurs as often."""
    w = phrases.withColumn("w", F.split("phrase", " ", -1)).where(F.size("w") > 2)
    inner = F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))
    inside = w.select("lang", "a", F.explode(F.transform(inner, lambda x: F.array_join(x, " "))).alias("phrase"))
    return ranked.join(inside, ["lang", "phrase", "a"], "left_anti")


def best_of_each(df: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their ranks; parts of a language are ranked first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    some = df.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, top: int = 2000, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language."""
    require_columns(docs, [lang, text])
    blocks = materialise(blocks_of(docs, lang, text), "phrase-blocks")
    # Entry 0 of a block's words stands between pieces.
    each = blocks.select("lang", F.explode(F.slice(F.arrays_zip("words", "counts"), F.lit(2), F.size("words"))).alias("x"))
    words = each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    sizes = blocks.select("lang", F.aggregate(F.slice("counts", F.lit(2), F.size("counts")), F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    totals = materialise(sizes.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    frequent = materialise(words.where(F.col("f") >= least), "phrase-words")
    blocks = materialise(frequent_only(blocks, hashes_of(frequent)), "phrase-frequent")
    bits = min(MOST_BITS, max(LEAST_BITS, (n // 4).bit_length()))
    known: list = []
    for level in range(2, longest + 1):
        known.append(sketch(blocks, level, max(LEAST_BITS, bits - level + 2), least, known))
    phrases = materialise(count_exactly(blocks, known, longest, least, shard), "phrase-counts")
    got = best_of_each(outermost(phrases, scored(phrases, frequent, totals)), top)
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
