"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token gets a segment tree whose leaves hold, for each adjacent pair of symbols, its
merge rank and place in one integer; the root is the leftmost pair of lowest rank. A merge
changes at most three leaves, and each change climbs to the root in logarithmic steps. Merging
ends when the root holds no pair. Short pre-tokens are merged together, one numpy step merging
a pair in each of them; long ones use the same tree in plain Python lists, so that a text
without spaces costs O(n log n).

Null texts count as empty; an empty text has no ids and decodes to itself. Special tokens in
a text are matched first, as the tokenizers library does. Input columns other than the text
and those to keep are not touched, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.chunks import ChunkEncoder, batches, text_of
from kpiscope.llm.common import require_columns, utf8

#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 40
#: Pre-tokens of more symbols than this are merged one at a time.
LONG = 256


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, all other bytes for the characters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = {}, 0x100
    for b in range(256):
        out[chr(b if b in shown else n)] = b
        n += b not in shown
    return out


class PairTable:
    """An open-addressing hash table from symbol pairs to merge ranks, looked up in batches."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.bits = max(10, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        keys = (left.astype(np.int64) << 20) | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            at, who = slot[todo][free], todo[free]
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.ranks[at] = keys[who[first]], who[first]
            done = np.zeros(len(keys), bool)
            done[who[first]] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class SegmentBpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"special token {t['content']!r} has options that are not supported")
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in word)
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.lens = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = PairTable(left, right)
        self._rank_of: dict[tuple[int, int], int] = {}
        self._left_right = (left, right)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.encoder = ChunkEncoder(self.encode_keys)

    # -- one batch of pre-tokens ---------------------------------------------------------

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in one array, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        width = 1
        order, out = [], []
        while width < 2 * LONG:
            # Words of width/2+2 .. width+1 bytes have up to ``width`` pairs.
            low = 0 if width == 1 else width // 2 + 1
            who = np.flatnonzero((sizes > low) & (sizes <= width + 1) & (sizes <= LONG))
            for i in range(0, len(who), 1 << 15):
                rows = who[i : i + (1 << 15)]
                ids, n = self._merge_rows([words[r] for r in rows], width)
                counts[rows] = n
                order.append(rows)
                out.append(ids)
            width *= 2
        for r in np.flatnonzero(sizes > LONG):
            ids = self._merge_long(words[r])
            counts[r] = len(ids)
            order.append(np.array([r]))
            out.append(np.array(ids, np.int64))
        if not out:
            return np.zeros(0, np.int64), counts
        flat, rows = np.concatenate(out), np.concatenate(order)
        # From the order by width back to the words' own order.
        starts = np.zeros(len(words), np.int64)
        starts[rows] = np.cumsum(counts[rows]) - counts[rows]
        ends = np.cumsum(counts)
        place = np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]))
        return flat[place], counts

    def _merge_rows(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n, cols = len(words), width + 1
        raw = np.zeros((n, cols), np.uint8)
        lens = np.fromiter(map(len, words), np.int64, n)
        raw[np.arange(cols) < lens[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        # Row-major flat arrays; one column more takes the writes of absent neighbours.
        step = cols + 1
        sym = np.full((n, step), -1, np.int64)
        sym[:, :cols] = self.byte_id[raw]
        sym[np.arange(step) >= lens[:, None]] = -1
        nxt = np.tile(np.arange(1, step + 1), (n, 1))
        prv = np.tile(np.arange(-1, step - 1), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        some = sym[:, 1:cols] >= 0
        if some.any():
            rank = self.pairs(sym[:, : cols - 1][some], sym[:, 1:cols][some])
            place = np.broadcast_to(np.arange(width), (n, width))[some]
            leaves = np.full((n, width), NONE, np.int64)
            leaves[some] = np.where(rank < NONE, rank * width + place, NONE)
            tree[:, width:] = leaves
            level = width
            while level > 1:
                level //= 2
                tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        sym_f, nxt_f, prv_f, tree_f = sym.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
        root = 1
        active = np.flatnonzero(tree[:, root] < NONE)
        climb = width.bit_length() - 1
        while len(active):
            top = tree_f[active * (2 * width) + root]
            pos, rank = top % width, top // width
            base = active * step
            here = base + pos
            right = nxt_f[here]
            after = nxt_f[base + right]
            new = self.merged[rank]
            sym_f[here] = new
            sym_f[base + right] = -1
            nxt_f[here] = after
            prv_f[base + np.minimum(after, step - 1)] = pos
            before = prv_f[here]
            n_act = len(active)
            # The merged symbol with its right and its left neighbour.
            after_sym = sym_f[base + np.minimum(after, step - 1)]
            has_r, has_l = after_sym >= 0, before >= 0
            left_sym = sym_f[base + np.maximum(before, 0)]
            both = self.pairs(
                np.concatenate([new, left_sym]), np.concatenate([np.maximum(after_sym, 0), new])
            )
            val_r = np.where(has_r & (both[:n_act] < NONE), both[:n_act] * width + pos, NONE)
            val_l = np.where(has_l & (both[n_act:] < NONE), both[n_act:] * width + before, NONE)
            root_at = active * (2 * width)
            node_h, node_r, node_l = pos + width, right + width, np.where(has_l, before, pos) + width
            tree_f[root_at + node_h] = val_r
            gone = right < width
            tree_f[(root_at + node_r)[gone]] = NONE
            node_r = np.where(gone, node_r, node_h)
            tree_f[(root_at + node_l)[has_l]] = val_l[has_l]
            rows3 = np.concatenate([root_at, root_at, root_at])
            nodes = np.concatenate([node_h, node_r, node_l])
            for _ in range(climb):
                nodes >>= 1
                child = rows3 + 2 * nodes
                tree_f[rows3 + nodes] = np.minimum(tree_f[child], tree_f[child + 1])
            active = active[tree_f[root_at + root] < NONE]
        keep = sym >= 0
        return sym[keep], keep.sum(1)

    def _rank(self, a: int, b: int) -> int:
        if not self._rank_of:
            self._rank_of = dict(zip(zip(*(x.tolist() for x in self._left_right)), range(len(self.merged))))
        return self._rank_of.get((a, b), -1)

    def _merge_long(self, word: bytes) -> list[int]:
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        width = 1 << (n - 2).bit_length()
        none, merged = int(NONE) * width, self.merged
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = self._rank(sym[i], sym[i + 1])
            if r >= 0:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = nxt[i]
            after = nxt[j]
            sym[i], sym[j], nxt[i] = int(merged[rank]), -1, after
            if j < n - 1:
                put(j, none)
            if after < n:
                prv[after] = i
                r = self._rank(sym[i], sym[after])
                put(i, none if r < 0 else r * width + i)
            else:
                put(i, none)
            if (p := prv[i]) >= 0:
                r = self._rank(sym[p], sym[i])
                put(p, none if r < 0 else r * width + p)
        return [s for s in sym if s >= 0]

    # -- texts ---------------------------------------------------------------------------

    def encode_keys(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, sizes, fixed = [], [], {}
        split = self.pattern.findall
        for key in keys:
            text = text_of(key)
            if self.cut is not None and "<" in text and self.cut.search(text):
                n, at = len(words), 0
                for m in self.cut.finditer(text):
                    words += [w.encode() for w in split(text[at : m.start()])]
                    fixed[len(words)] = self.special[m[0]]
                    words.append(b"")
                    at = m.end()
                words += [w.encode() for w in split(text[at:])]
                sizes.append(len(words) - n)
            else:
                got = split(text)
                words += [w.encode() for w in got]
                sizes.append(len(got))
        ids, counts = self.merge_all(words)
        if fixed:
            where = np.array(sorted(fixed))
            ids = np.insert(ids, np.cumsum(counts)[where], [fixed[i] for i in where.tolist()])
            counts[where] = 1
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return ids.astype(np.int32), np.diff(ends)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.encoder(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> str:
        """As the library: the ids' bytes, with U+FFFD for what is not UTF-8."""
        return self.bytes_for(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def bytes_for(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of ids[bounds[i]:bounds[i + 1]] for each i, gathered in one numpy pass."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat((self.starts[ids] - (ends - lens)).astype(np.int32), lens)
        place += np.arange(total, dtype=np.int32)
        out = self.flat[place].tobytes()
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def load(path: str) -> SegmentBpe:
    return SegmentBpe(path)


def encode_documents(
    docs: DataFrame, vocab_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    ids: str | None = "ids", decoded: str | None = None, digests: bool = False,
) -> DataFrame:
    """Encode each text, and decode it again if asked.

    Returns the ``keep`` columns, ``n_tokens``, and as asked: ``ids`` (array<int>), ``decoded``
    (string), or ``ids_sha256`` and ``decoded_sha256``. A map over partitions: no shuffle.
    """
    require_columns(docs, [text, *keep])
    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long"]
    schema += [f"`{ids}` array<int>"] * bool(ids) + [f"`{decoded}` string"] * bool(decoded)
    schema += ["ids_sha256 string", "decoded_sha256 string"] * digests

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for part in parts:
            raw = part.column(part.num_columns - 1).to_pylist()
            for a, b in batches(raw):
                flat, counts = bpe.encoder([t.decode() for t in raw[a:b]])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                cols = [part.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(counts, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())))
                if decoded or digests:
                    each = [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                    back = [x.decode("utf-8", "replace") for x in bpe.bytes_for(flat, bounds)]
                    if decoded:
                        cols.append(pa.array(back, pa.string()))
                    if digests:
                        cols.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()))
                        cols.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    # Positional columns: a kept column may bear any name.
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], utf8(f"`{text}`").alias("raw"))
    names = [x.split("`")[1] if x.startswith("`") else x.split(" ")[0] for x in schema]
    plain = ", ".join(f"c{i} {x.split('` ')[1] if x.startswith('`') else x.split(' ', 1)[1]}" for i, x in enumerate(schema))
    return slim.mapInArrow(run, plain).toDF(*names)


def decode_documents(docs: DataFrame, vocab_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add ``out``, the text of the array<int> column ``ids``; null ids give a null text."""
    schema = [*[f for f in docs.schema.fields if f.name != out]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for part in parts:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    from pyspark.sql.types import StringType, StructField, StructType

    kept = docs.select(*[F.col(f"`{f.name}`") for f in schema])
    return kept.mapInArrow(run, StructType([*schema, StructField(out, StringType())]))
