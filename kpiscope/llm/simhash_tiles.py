"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each of 64 places, set if it is set in over half of the
XXH64 values of its word shingles. All distinct fingerprints are compared with each other, tile
by tile, with numpy exclusive-or and bit counts. Two fingerprints cannot be within the radius
if the counts of their set bits, over all 64 places or summed over the four 16-bit quarters,
differ by more; tiles hold fingerprints of like counts, so most pairs of tiles are skipped.

The work is exact and so, even with the skipped tiles, grows faster than the input; what is
shuffled stays linear until a strip reaches ``STRIP_MOST`` fingerprints (see the README).

Copies cost nothing: only distinct fingerprints are compared. Links are not expanded into all
pairs: each task returns a spanning forest of what it found, and components are found by star
contraction over tables in the shared folder, with nothing collected to the driver.

With ``min_similarity`` a link needs that share of common distinct shingles, and the shingle
sets decide it. Sets whose sizes alone exclude it are not compared; of the others those within
the radius whose 128-bin one-permutation sketch estimates at least ``SLACK`` less are candidates.
Of the candidates each task returns a spanning forest only. Within the groups that these forests
make, the shingle sets are brought together, small groups many to a task, large ones as pairs of
tiles, and the Jaccard similarity of every pair that is not linked already is taken from the sets
where they are; a task returns a spanning forest of the links it found. So no pair is shipped, and
a crowd of near misses costs comparisons in its tiles, but no rows.

Null texts count as empty; texts without words have fingerprint zero and are linked like any
other. Rows with a null id take part (as copies of what they equal) and get their component;
repeated ids give repeated rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.common import delete_path, materialise, new_path, require_columns, utf8

SEED = 42
BINS = 128
#: A sketch may fall this far below the similarity asked for: of pairs at 0.8 exactly, less than
#: one in 10^7 does (128 bins, binomial).
SLACK = 0.2
#: Sets of up to SMALL shingles have a radius larger by WIDER, as their fingerprints scatter more.
SMALL, WIDER = 32, 4
#: Sets in a tile of a large group: at most so many, with so many shingles on average.
GROUP_NODES, GROUP_SHINGLES = 2048, 1 << 21
#: Components above HOT_LEAST nodes and this share of all nodes are few enough to broadcast.
HOT_LEAST, HOT_ROOTS = 100, 10_000
TILE = 256
#: Fingerprints in a strip: at least, and at most (a task holds two strips).
STRIP_LEAST, STRIP_MOST = 1 << 16, 1 << 19
#: Strips are made larger rather than more than this many, until they reach STRIP_MOST: what is
#: shuffled for the comparison is this many times the fingerprints and sketches at most.
STRIPS = 32


def shingle_hashes(text: bytes, words: int, block: int = 1 << 17) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle of ``words`` words, in blocks of one document's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = text.lower().split()
    if not parts:
        return
    if len(parts) < words:
        yield np.array([digest(b" ".join(parts), SEED)], np.uint64)
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1]
    ends = ends[words - 1 :]
    for i in range(0, len(starts), block):
        a, b = starts[i : i + block].tolist(), ends[i : i + block].tolist()
        yield np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    blocks = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def set_node(hashes: np.ndarray) -> int:
    """The XXH64 of a set of shingles, as a signed integer."""
    import xxhash

    h = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, mark, raw): mark is the text's hash; key is it for texts without an id."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(f"`{text}`").alias("raw")).withColumn("mark", F.xxhash64("raw"))
    return slim.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("mark")).alias("key"), "mark", "raw")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The places set in over half of the hashes, as a signed integer."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        n += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int, sketch: bool = False, block: int = 1 << 17) -> tuple[int, bytes, int, int]:
    """The fingerprint, the one-permutation sketch, the number of distinct shingles and the node.

    With ``sketch`` all are of the set of shingles, and the node is the hash of the set; without,
    repeated shingles count, the node is the fingerprint, and the sketch stays empty.
    """
    if not sketch:
        bits = majority(shingle_hashes(text, words))
        return bits, b"", 0, bits
    h = shingle_set(text, words)
    bits = majority(h[i : i + block] for i in range(0, len(h), block))
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    got = np.zeros(BINS, np.uint8)
    got[bins[first]] = 1 + ((h[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(255)
    return bits, got.tobytes(), len(h), set_node(h)


def fingerprints(docs: DataFrame, words: int, sketch: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, mark, fp, sketch, size, node): node stands for what is compared, equal for copies."""
    require_columns(docs, [text, doc_id])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [fingerprint(t.as_py(), words, sketch) for t in part.column(3)]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *[pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]],
                names=[f.name for f in schema.fields],
            )

    slim = keyed(docs, text, doc_id)
    schema = T.StructType([*slim.schema.fields[:3], *T.StructType.fromDDL("fp long, sketch binary, size long, node long").fields])
    return slim.mapInArrow(run, schema)


class Forest:
    """Connected components of local indices, kept flat."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


    def choose(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The positions of pairs that, taken in turn, join two components; they are joined."""
        up: dict[int, int] = {}

        def find(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        chosen = []
        for k, (a, b) in enumerate(zip(self.root[i].tolist(), self.root[j].tolist())):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                chosen.append(k)
        got = np.array(chosen, np.int64)
        self.join(i[got], j[got])
        return got


def quarter_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view("<u2").reshape(-1, 4)).astype(np.int16)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles of rows of sketches."""
    either = ((a | b) != 0).sum(1)
    return np.where(either == 0, 1.0, ((a == b) & (a != 0)).sum(1) / np.maximum(either, 1))


def link_tiles(fps: np.ndarray, sketches: np.ndarray | None, split: int, radius: int, least: float) -> np.ndarray:
    """The root of each fingerprint after linking those within the radius.

    ``split`` of 0 compares all with all; else the first ``split`` with the others only.
    """
    forest = Forest(len(fps))
    counts = quarter_counts(fps)
    total = counts.sum(1)

    def tiles(start: int, end: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
        c, t = counts[start:end], total[start:end]
        order = start + np.lexsort((c[:, 3], c[:, 2], c[:, 0], c[:, 0] + c[:, 1], t))
        out = []
        for k in range(0, len(order), TILE):
            rows = order[k : k + TILE]
            q = counts[rows]
            out.append((rows, q.min(0), q.max(0), int(total[rows].min()), int(total[rows].max())))
        return out

    left = tiles(0, split or len(fps))
    right = tiles(split, len(fps)) if split else left
    low, high = (np.array([t[k] for t in right]).reshape(len(right), -1) for k in (1, 2))
    low_t, high_t = (np.array([t[k] for t in right]) for k in (3, 4))
    for x, (rows, qa, qb, ta, tb) in enumerate(left):
        gap = np.maximum(np.maximum(low - qb, qa - high), 0).sum(1)
        gap = np.maximum(gap, np.maximum(low_t - tb, ta - high_t))
        near = np.flatnonzero(gap <= radius)
        if not split:
            near = near[near >= x]
        mine = fps[rows]
        for y in near:
            other = right[y][0]
            close = np.bitwise_count(mine[:, None] ^ fps[other][None, :]) <= radius
            at = np.flatnonzero(close)
            if not len(at):
                continue
            i, j = rows[at // len(other)], other[at % len(other)]
            keep = forest.root[i] != forest.root[j]
            i, j = i[keep], j[keep]
            if sketches is not None and len(i):
                keep = similarity(sketches[i], sketches[j]) >= least
                i, j = i[keep], j[keep]
            forest.join(i, j)
    return forest.root


def candidate_tiles(fps: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, split: int, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of indices whose sets may share ``least`` of their shingles
    (see the module). ``split`` as in ``link_tiles``."""
    forest, firsts, seconds = Forest(len(fps)), [], []

    def tiles(start: int, end: int) -> list[np.ndarray]:
        order = start + np.lexsort((fps[start:end], sizes[start:end]))
        return [order[k : k + TILE] for k in range(0, len(order), TILE)]

    left = tiles(0, split or len(fps))
    right = tiles(split, len(fps)) if split else left
    low, high = (np.array([sizes[t[k]] for t in right]) for k in (0, -1))
    for x, rows in enumerate(left):
        small, large = sizes[rows[0]], sizes[rows[-1]]
        near = np.flatnonzero((low * least <= large) & (small * least <= high))
        if not split:
            near = near[near >= x]
        mine = fps[rows]
        for y in near:
            other = right[y]
            within = radius + WIDER * int(min(small, low[y]) <= SMALL)
            at = np.flatnonzero(np.bitwise_count(mine[:, None] ^ fps[other][None, :]) <= within)
            k, l = at // len(other), at % len(other)
            if not split and y == x:
                k, l = k[k < l], l[k < l]
            i, j = rows[k], other[l]
            si, sj = sizes[i], sizes[j]
            keep = np.minimum(si, sj) >= least * np.maximum(si, sj)
            keep &= forest.root[i] != forest.root[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            keep = similarity(sketches[i], sketches[j]) >= least - SLACK
            i, j = i[keep], j[keep]
            chosen = forest.choose(i, j)
            firsts.append(i[chosen])
            seconds.append(j[chosen])
    none = [np.empty(0, np.int64)]
    return np.concatenate(firsts or none), np.concatenate(seconds or none)


def strips_of(counts: dict[int, int], kinds: int = 65) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """From the number of fingerprints for each bit count: the first strip and the number of
    strips of each bit count, and each strip's least and largest bit count."""
    n = sum(counts.values())
    size = min(STRIP_MOST, max(STRIP_LEAST, -(-n // STRIPS)))
    first, many, spans = [0] * kinds, [1] * kinds, []
    filled = size
    for p in range(kinds):
        c = counts.get(p, 0)
        if c > size:
            many[p] = -(-c // size)
            first[p] = len(spans)
            spans += [(p, p)] * many[p]
            filled = size
        elif not spans or filled + c > size:
            first[p] = len(spans)
            spans.append((p, p))
            filled = c
        else:
            first[p] = len(spans) - 1
            spans[-1] = (spans[-1][0], p)
            filled += c
    return first, many, spans


Compare = Callable[[dict[str, np.ndarray], int], tuple[np.ndarray, np.ndarray]]


def compared(nodes: DataFrame, kind: Column, kinds: int, reach: int, columns: dict[str, str], compare: Compare) -> DataFrame:
    """Edges (a, b) that ``compare`` finds between nodes whose kinds differ by ``reach`` at most.

    Nodes are dealt into strips by kind (a count for each kind reaches the driver) and each pair
    of strips within reach is one task. ``compare`` takes the columns, node among them, by name
    and the length of the first strip (0 if there is one only), and returns pairs of indices.
    """
    counts = {r[0]: r[1] for r in nodes.groupBy(kind.alias("p")).count().collect()}
    first, many, spans = strips_of(counts, kinds)
    pairs = [(i, j) for i in range(len(spans)) for j in range(i, len(spans)) if spans[j][0] - spans[i][1] <= reach]
    of: list[list[int]] = [[] for _ in spans]
    for k, (i, j) in enumerate(pairs):
        of[i].append(k)
        if j != i:
            of[j].append(k)
    names = list(columns)
    strip = F.get(F.lit(np.array(first)), kind) + F.pmod(F.xxhash64("node", F.lit(7)), F.get(F.lit(np.array(many)), kind))
    dealt = nodes.select(strip.cast("int").alias("strip"), *names)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a batch that are of one strip become one row of binary values."""
        for part in parts:
            at = np.asarray(part.column(0))
            order = np.argsort(at, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(rows):
                    take = part.take(pa.array(rows))
                    cells = [b"".join(take.column(n).to_pylist()) if columns[n] == "bytes" else np.asarray(take.column(n)).astype("<i8").tobytes() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array([int(at[rows[0]])], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["strip", *names])

    packed = dealt.mapInArrow(pack, "strip int, " + ", ".join(f"{n} binary" for n in names))
    lookup = F.array(*[F.array(*[F.lit(k) for k in ks]) for ks in of])
    sent = packed.withColumn("pair", F.explode(F.get(lookup, F.col("strip"))))
    owner = {k: i for k, (i, _) in enumerate(pairs)}
    same = {k for k, (i, j) in enumerate(pairs) if i == j}

    def run(key: tuple, got: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        is_left = np.array([s == owner[pair] for s in got.column("strip").to_pylist()])
        order = np.concatenate([np.flatnonzero(is_left), np.flatnonzero(~is_left)])

        def whole(name: str) -> np.ndarray:
            col = got.column(name).to_pylist()
            joined = np.frombuffer(b"".join(col[i] for i in order), np.uint8)
            return joined.reshape(-1, BINS) if columns[name] == "bytes" else joined.view(columns[name])

        split = 0 if pair in same else sum(len(v.as_py()) // 8 for v, l in zip(got.column("node"), is_left) if l)
        table = {n: whole(n) for n in names}
        i, j = compare(table, split) if pair in same or split < len(table["node"]) else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(table["node"][i], pa.int64()), "b": pa.array(table["node"][j], pa.int64())})

    return sent.groupBy("pair").applyInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between nodes within the radius, a spanning forest of each task's links."""

    def compare(t: dict[str, np.ndarray], split: int) -> tuple[np.ndarray, np.ndarray]:
        root = link_tiles(t["fp"], None, split, radius, 0.0)
        child = np.flatnonzero(root != np.arange(len(root)))
        return child, root[child]

    return compared(nodes, F.bit_count("fp"), 65, radius, {"node": "<i8", "fp": "<u8"}, compare)


def candidates(nodes: DataFrame, radius: int, least: float) -> DataFrame:
    """Edges (a, b) between nodes (node, fp, sketch, size): a forest of candidates for ``least``
    from each task (see ``candidate_tiles``). Sizes are dealt by their logarithm: those of one or of
    neighbouring kinds cover all ratios from ``least`` up, with a margin for rounding."""
    base = math.log(1.01 / least)
    kind = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / base).cast("int")
    columns = {"node": "<i8", "fp": "<u8", "sketch": "bytes", "size": "<i8"}

    def compare(t: dict[str, np.ndarray], split: int) -> tuple[np.ndarray, np.ndarray]:
        return candidate_tiles(t["fp"], t["sketch"], t["size"], split, radius, least)

    return compared(nodes, kind, int(math.log(2**40) / base) + 1, 1, columns, compare)


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return not len(y)
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def linked_sets(sets: list[np.ndarray], sketches: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of sets (or within one, given twice).
    Pairs of high estimate are tried first; pairs already linked are not tried."""
    sizes, out, same = np.array([len(x) for x in sets]), [], left is right
    forest = Forest(len(sets))
    for p in range(0, len(left), 64):
        rows = left[p : p + 64]
        for q in range(p if same else 0, len(right), 1024):
            others = right[q : q + 1024]
            a, b = sizes[rows][:, None], sizes[others][None, :]
            keep = np.minimum(a, b) >= least * np.maximum(a, b)
            keep &= forest.root[rows][:, None] != forest.root[others][None, :]
            if same:
                keep &= np.arange(p, p + len(rows))[:, None] < np.arange(q, q + len(others))[None, :]
            k, l = np.nonzero(keep)
            i, j = rows[k], others[l]
            share = similarity(sketches[i], sketches[j])
            good = np.flatnonzero(share >= least - SLACK)
            good = good[np.argsort(-share[good], kind="stable")]
            up: dict[int, int] = {}

            def find(v: int) -> int:
                while (w := up.get(v, v)) != v:
                    v = w
                return v

            found = []
            for x, y, rx, ry in zip(i[good].tolist(), j[good].tolist(), forest.root[i[good]].tolist(), forest.root[j[good]].tolist()):
                rx, ry = find(rx), find(ry)
                if rx != ry and alike(sets[x], sets[y], least):
                    up[max(rx, ry)] = min(rx, ry)
                    found.append((x, y))
            if found:
                forest.join(*(np.array(c) for c in zip(*found)))
                out += found
    return out


def similar_links(nodes: DataFrame, docs: DataFrame, words: int, radius: int, least: float, text: str, doc_id: str) -> DataFrame:
    """Edges (a, b) between nodes that connect all candidates of at least that similarity."""
    groups = materialise(components(candidates(nodes, radius, least)), "groups")
    ids = nodes.join(groups, "node").select("node", "root", "sketch", "size", F.col("first").alias("_id"), F.col("key").alias("_key"))
    slim = keyed(docs, text, doc_id)

    def shingle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A repeated id may stand for several texts: only the node's own counts."""
        for part in parts:
            at, got = [], []
            for k, (node, raw) in enumerate(zip(part.column(0).to_pylist(), part.column(4))):
                hashes = shingle_set(raw.as_py(), words)
                if set_node(hashes) == node:
                    at.append(k)
                    got.append(hashes.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*part.select(["node", "root", "sketch", "size"]).take(pa.array(at, pa.int64())).columns, pa.array(got, pa.binary())], names=["node", "root", "sketch", "size", "hashes"])

    own = slim.join(ids, slim["doc_id"].eqNullSafe(ids["_id"]) & slim["key"].eqNullSafe(ids["_key"])).select("node", "root", "sketch", "size", "raw")
    sets = materialise(own.mapInArrow(shingle, "node long, root long, sketch binary, size long, hashes binary").dropDuplicates(["node"]), "sets")
    # Large groups are cut into tiles. There is at most one for each GROUP_NODES nodes and one for each
    # GROUP_SHINGLES shingles, which bounds what is broadcast.
    tiles = F.greatest(F.ceil(F.count("*") / GROUP_NODES), F.ceil(F.sum("size") / GROUP_SHINGLES)).cast("int")
    large = sets.groupBy("root").agg(tiles.alias("k")).where("k > 1")
    totals = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    buckets = max(1, -(-totals["n"] // GROUP_NODES), -(-totals["s"] // GROUP_SHINGLES))
    dealt = sets.join(F.broadcast(large), "root", "left").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("k", F.lit(1))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1), lambda u: F.struct(F.least("tile", u).alias("i"), F.greatest("tile", u).alias("j")))
    task = F.when(F.col("k").isNull(), F.pmod(F.xxhash64("root", F.lit(6)), F.lit(buckets))).otherwise(F.col("root"))
    dealt = dealt.select(F.col("k").isNotNull().alias("big"), task.alias("task"), F.explode(pairs).alias("p"), "tile", "node", "root", "sketch", "hashes")
    dealt = dealt.select("big", "task", "p.i", "p.j", "tile", "node", "root", "sketch", "hashes")

    def run(key: tuple, got: pa.Table) -> pa.Table:
        node, root, tile = (np.asarray(got.column(c)) for c in ("node", "root", "tile"))
        hashes = [np.frombuffer(h.as_py(), "<u8") for h in got.column("hashes")]
        sketches = np.frombuffer(b"".join(got.column("sketch").to_pylist()), np.uint8).reshape(len(node), BINS)
        i, j = key[2].as_py(), key[3].as_py()
        found: list[tuple[int, int]] = []
        if i != j:
            found = linked_sets(hashes, sketches, np.flatnonzero(tile == i), np.flatnonzero(tile == j), least)
        else:
            order = np.argsort(root, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
                if len(rows) > 1:
                    few = [hashes[r] for r in rows]
                    every = np.arange(len(rows))
                    found += [(int(rows[x]), int(rows[y])) for x, y in linked_sets(few, sketches[rows], every, every, least)]
        a, b = (np.array([node[f[c]] for f in found], np.int64) for c in (0, 1))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("big", "task", "i", "j").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, by alternating large and small stars.

    Each round writes its edges to the shared folder; it ends when a round changes nothing.
    """
    spark = edges.sparkSession

    def state(path: str) -> tuple:
        return tuple(spark.read.parquet(path).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # each node's larger neighbours go to the least of it and all its neighbours
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # each node and its smaller neighbours go to the least of these
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(least, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    path = new_path(spark, "edges")
    edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(path)
    before = state(path)
    while before[0]:
        e = spark.read.schema("a long, b long").parquet(path)
        half = new_path(spark, "edges")
        star(e, True).write.parquet(half)
        nxt = new_path(spark, "edges")
        star(spark.read.schema("a long, b long").parquet(half), False).write.parquet(nxt)
        delete_path(spark, half)
        delete_path(spark, path)
        path, now = nxt, state(nxt)
        if now == before:
            break
        before = now
    e = spark.read.schema("a long, b long").parquet(path)
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _groups(docs: DataFrame, words: int, radius: int, min_similarity: float | None, text: str, doc_id: str) -> DataFrame:
    """(doc_id, fp, component_id, mark) of every row."""
    prints = materialise(fingerprints(docs, words, min_similarity is not None, text, doc_id), "prints")
    parts = [F.first(c).alias(c) for c in (["fp"] if min_similarity is None else ["fp", "sketch", "size"])]
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), *parts)
    nodes = materialise(nodes.withColumn("key", F.when(F.col("first").isNull(), F.col("key"))), "nodes")
    if min_similarity is None:
        edges = links(nodes, radius)
    else:
        edges = similar_links(nodes, docs, words, radius, min_similarity, text, doc_id)
    found = components(edges)
    linked = materialise(nodes.select("node", "first").join(found, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n"))
    # A component of many nodes would meet in one task of the join: these are joined by broadcast.
    # There are at most HOT_ROOTS of them, as each holds more than that share of the nodes.
    hot_size = max(HOT_LEAST, linked.count() // HOT_ROOTS)
    hot = least.where(F.col("n") > hot_size).select("root", F.col("component").alias("hot"))
    marked = linked.join(F.broadcast(hot), "root", "left")
    cold = marked.where("hot is null").select("root", "node").join(least.where(F.col("n") <= hot_size).select("root", "component"), "root").select("node", "component")
    moved = marked.where("hot is not null").select("node", F.col("hot").alias("component")).union(cold)
    known = nodes.select("node", "first").join(moved, "node", "left")
    known = materialise(known.select("node", F.coalesce("component", "first").alias("component_id")), "members")
    return prints.join(known, "node").select("doc_id", "fp", "component_id", "mark")


def near_duplicates(
    docs: DataFrame, words: int = 5, radius: int = 24, min_similarity: float | None = 0.8,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links. Ids
    are of any type that has an order."""
    return _groups(docs, words, radius, min_similarity, text, doc_id).drop("mark")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 24, min_similarity: float | None = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group: that with the smallest id. The columns stay as they are.

    Rows without an id stay. Rows that share an id are judged each by its own text, so one may
    go and the other stay; equal rows of the smallest id all stay. Text columns may have any names.
    """
    found = _groups(docs, words, radius, min_similarity, text, doc_id)
    gone = found.where("doc_id != component_id").select("doc_id", "mark").distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, mark = plain[f"c{names.index(doc_id)}"], F.xxhash64(utf8(f"c{names.index(text)}"))
    return plain.join(gone, (own == gone["doc_id"]) & (mark == gone["mark"]), "left_anti").toDF(*names)
