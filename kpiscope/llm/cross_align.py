"""Alignment of two tokenizers' tokens by deduplicated segments.

A: a byte-level BPE file of the tokenizers library, which gets a space and the text. B: a SentencePiece BPE
model, which puts that space before the text itself. Texts are cut before runs of white space, at places
where neither vocabulary can merge across (``safe_spaces`` verifies that from the files). Blocks of
documents hold their distinct segments and, for each document, their numbers; all blocks'
distinct segments meet once, each is tokenised and aligned once, and the alignments are joined back to the
blocks, where documents are composed from them.

Groups end at the byte offsets where tokens of both end. Links are the pairs of an A and a B
token whose byte ranges overlap. Each block then counts, for each pair of ids, its documents that hold it;
the sums over all blocks are joined back in the same way to give each document's links their counts.

Only distinct segments and pairs of a block are shuffled, packed by block and bucket, so a segment that each
document holds costs a place a block, and a source of a third of all rows nothing more than its blocks. Buckets are
sorted streams, of which a task holds the distinct segments (or pairs) of one. A block closes at
``BLOCK_BYTES`` of text; a longer text is a block by itself.

Texts that are null, empty, or not given back byte by byte by both (a U+2581 in a text, say) have no
tokens: zeros and an empty string; their tokens are in no count. Special tokens' names within texts are plain text. Repeated
rows and equal or null ids each give a row. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kpiscope.llm.bpe_segment import byte_alphabet
from kpiscope.llm.common import materialise, require_columns, utf8

#: Text bytes after which a block of documents closes.
BLOCK_BYTES = 12 << 20
#: Segments (and pairs) of all blocks are dealt into buckets of about so many.
BUCKET = 1 << 18
#: Segments whose documents are counted at a time within a block.
RANGE = 1 << 19
SHIFT = 32
#: White space that a text may be cut before; U+180E is white space to some engines only.
SPACES = " \t\n\x0b\x0c"
_OTHER = r"[^\s᠎]"


def safe_spaces(a_path: str, b_path: str) -> str:
    """The characters of ``SPACES`` before which a text may be cut after another character.

    A: a byte-level pre-tokeniser ends its pieces there, and merges stay within pieces. B: no piece may hold
    such a character after one that is no white space; and but for the space itself, which B's own
    prefix gives, none may hold it after a space, so that the prefix stands apart as a token to drop.
    """
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        file = json.load(f)
    pre = file.get("pre_tokenizer") or {}
    if file.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        return ""
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    if not b.encode("a", out_type=str)[0].startswith("▁") or b.encode("▁", out_type=str) != ["▁▁"]:
        return ""
    pieces = [b.id_to_piece(i).replace("▁", " ") for i in range(b.get_piece_size()) if not b.is_byte(i)]

    def safe(c: str) -> bool:
        after = re.compile(_OTHER + re.escape(c) + ("" if c == " " else "| " + re.escape(c)))
        return not any(c in p and after.search(p) for p in pieces)

    return "".join(filter(safe, SPACES))


def cutter(spaces: str) -> re.Pattern[str] | None:
    return re.compile(rf"(?<={_OTHER})(?=[{re.escape(spaces)}])") if spaces else None


def whole(key: str) -> str:
    """A segment by its key: a word's key lacks the space before it, other white space stays."""
    return key if key[0].isspace() else " " + key


def keys_of(text: str, cut: re.Pattern[str] | None) -> list[str]:
    """The keys of the segments of a space and the text; none of an empty text."""
    if not text:
        return []
    if cut and "᠎" not in text:
        # No white space but single spaces and line feeds between other characters.
        if " ".join(text.split()) == text.replace("\n", " "):
            return text.replace("\n", " \n").split(" ")
    return [s[1:] if s[1:2] and s[0] == " " and not s[1].isspace() else s for s in (cut.split(" " + text) if cut else [" " + text])]


A_ENDS, B_ENDS, BOTH_END = 1, 2, 3


def path(a_sizes: Sequence[int], b_sizes: Sequence[int]) -> bytes:
    """One byte a link, in order: which of its two tokens ends first, or both (a group's end)."""
    n, m = len(a_sizes), len(b_sizes)
    if n == 1 or m == 1:
        return bytes([A_ENDS if m == 1 else B_ENDS]) * (max(n, m) - 1) + bytes([BOTH_END])
    out, i, j, left = bytearray(), 0, 0, 0  # left: bytes by which the A token ends after the B token
    left = a_sizes[0] - b_sizes[0]
    while True:
        if left < 0:
            out.append(A_ENDS)
            i += 1
            left += a_sizes[i]
        elif left > 0:
            out.append(B_ENDS)
            j += 1
            left -= b_sizes[j]
        else:
            out.append(BOTH_END)
            i, j = i + 1, j + 1
            if i == n:
                return bytes(out)
            left = a_sizes[i] - b_sizes[j]


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for word, i in self.a.get_vocab().items():
            self.a_bytes[i] = word.encode() if word in special else bytes(alphabet[c] for c in word)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.prefix = self.b.piece_to_id("▁")

    def encode(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of each segment. B puts a space before what it gets: a segment's own
        first space is left to it, and before other white space its token is dropped."""
        segs = list(map(whole, keys))
        a = [e.ids for e in self.a.encode_batch_fast(segs, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segs], num_threads=1)
        for i, s in enumerate(segs):
            if s == " ":
                b[i] = [self.prefix]
            elif s[0] != " ":
                # Without the prefix as a token of its own the segment was cut wrongly.
                if b[i][:1] != [self.prefix]:
                    raise ValueError("the vocabulary merges over a cut")
                b[i] = b[i][1:]
        return a, b

    def align(self, key: str, a: list[int], b: list[int]) -> tuple[bytes, list[int], list[int], str]:
        """The path of links, both ids and the groups; all empty if the bytes are not given back."""
        bytes_a, bytes_b = [self.a_bytes[x] for x in a], [self.b_bytes[x] for x in b]
        raw = whole(key).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return b"", [], [], ""
        if len(a) == 1 and len(b) == 1:
            return b"\x03", a, b, f"{a[0]}|{b[0]}"
        moves = path(list(map(len, bytes_a)), list(map(len, bytes_b)))
        if moves.count(BOTH_END) == 1:
            return moves, a, b, ",".join(map(str, a)) + "|" + ",".join(map(str, b))
        groups, i, j, i0, j0 = [], 0, 0, 0, 0
        for move in moves:
            i += move & 1
            j += move >> 1
            if move == BOTH_END:
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                i0, j0 = i, j
        return moves, a, b, ";".join(groups)


@lru_cache(maxsize=1)
def load(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed integers, the bytes of each order together."""
    import zstandard

    v = np.ascontiguousarray(values, "<i8")
    return zstandard.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def _spread(raw: bytes) -> np.ndarray:
    import zstandard

    b = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(b.reshape(8, -1).T).reshape(-1).view("<i8")


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def blocks_of(docs: DataFrame, doc_id: str, text: str, spaces: str, block_bytes: int) -> DataFrame:
    """(block, ids, sizes, codes, n_keys, keys): documents by their segments' numbers."""
    id_type = docs.schema[doc_id].dataType
    fields = [
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()),
        T.StructField("n_keys", T.LongType()), T.StructField("keys", T.ArrayType(T.StringType())),
    ]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, no = cutter(spaces), TaskContext.get().partitionId() << 32
        ids, sizes, codes, index, held = [], [], [], _Numbers(), 0

        def close() -> pa.RecordBatch:
            nonlocal no, ids, sizes, codes, index, held
            all_codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            row = [no, ids, _squeeze(np.array(sizes)), _squeeze(all_codes), len(index), list(index)]
            no, ids, sizes, codes, index, held = no + 1, [], [], [], _Numbers(), 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[f.name for f in fields])

        for part in parts:
            for i, raw in zip(part.column(0).to_pylist(), part.column(1)):
                t = raw.as_buffer().to_pybytes().decode()
                got = keys_of(t, cut)
                ids.append(i)
                sizes.append(len(got))
                codes.append(np.fromiter(map(index.__getitem__, got), np.int32, len(got)))
                held += len(t) + 64
                if held >= block_bytes:
                    yield close()
        if ids:
            yield close()

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(f"`{text}`").alias("raw"))
    return slim.mapInArrow(run, T.StructType(fields))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _pack(texts: list[str]) -> bytes:
    """Texts in one compressed value."""
    import zstandard

    raw = "".join(texts).encode("utf-32-le")
    sizes = _squeeze(np.array([len(t) for t in texts], np.int64))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(raw: bytes) -> list[str]:
    import zstandard

    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(_spread(raw[4 : 4 + n])).tolist()
    flat = np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw[4 + n :]), np.uint8).reshape(4, -1).T).tobytes().decode("utf-32-le")
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


KEYS = "bucket int, block long, places binary, keys binary"
LINKED = "block long, places binary, n_links binary, moves binary, a binary, b binary, groups binary"
SUMS = ("n_a", "n_b", "n_groups", "n_links")


def dealt_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's segments by bucket of their hash, a row for each block and bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts:
            for block, keys in zip(part.column(0).to_pylist(), part.column(1)):
                keys = keys.as_py()
                to = np.array([xxhash.xxh3_64_intdigest(k.encode()) % buckets for k in keys], np.int64)
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(buckets + 1)).tolist()
                for bucket, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if x < y:
                        mine = order[x:y]
                        yield _batch(KEYS, [(bucket, block, _squeeze(np.diff(mine, prepend=0)), _pack([keys[i] for i in mine.tolist()]))])

    return blocks.select("block", "keys").mapInArrow(run, KEYS)


def align_keys(dealt: DataFrame, buckets: int, a_path: str, b_path: str) -> DataFrame:
    """Segments aligned, a row for each block and bucket. Buckets are sorted streams: a task holds the
    alignments of one bucket's distinct segments, each of which is tokenised once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, now, known = load(a_path, b_path), None, {}
        for part in parts:
            for row in part.to_pylist():
                if row["bucket"] != now:
                    now, known = row["bucket"], {}
                keys = _unpack(row["keys"])
                new = [k for k in keys if k not in known]
                for i in range(0, len(new), 10_000):
                    some = new[i : i + 10_000]
                    known.update(zip(some, map(both.align, some, *both.encode(some))))
                moves, a, b, groups = zip(*map(known.__getitem__, keys))
                flat = lambda lists: _squeeze(np.fromiter(chain.from_iterable(lists), np.int64))
                yield _batch(LINKED, [(
                    row["block"], row["places"], _squeeze(np.array(list(map(len, moves)))), _squeeze(np.frombuffer(b"".join(moves), np.uint8)), flat(a), flat(b), _pack(list(groups)),
                )])

    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, LINKED)


def _compose(linked: pa.Table, block: pa.Table, with_groups: bool) -> pa.Table:
    """One block's documents, its pairs with the number of its documents that hold them, and
    how often each document does (``key``: document x pairs + pair)."""
    rows = linked.to_pylist()
    parts = {c: [_spread(r[c]) for r in rows] for c in ("places", "n_links", "moves", "a", "b")}
    joined = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in parts.items() if c != "places"}
    place = np.concatenate([np.cumsum(x) for x in parts["places"]]) if rows else np.zeros(0, np.int64)
    names = [t for r in rows for t in _unpack(r["groups"])]
    sizes, codes = _spread(block["sizes"][0].as_py()), _spread(block["codes"][0].as_py())
    n, width = len(sizes), max(len(place), 1)
    number = np.zeros(width, np.int64)
    number[place] = np.arange(len(place))
    codes = number[codes]

    # A segment's last link ends both its tokens, so places run on from segment to segment.
    moves, counts = joined["moves"], joined["n_links"]
    last = np.cumsum(counts)
    ended = {"n_a": moves & 1, "n_b": moves >> 1, "n_groups": (moves == BOTH_END).astype(np.int64), "n_links": np.ones(len(moves), np.int64)}
    upto = {c: np.concatenate([[0], np.cumsum(v)]) for c, v in ended.items()}
    flat = (joined["a"][upto["n_a"][:-1]] << SHIFT) | joined["b"][upto["n_b"][:-1]] if len(moves) else np.zeros(0, np.int64)

    doc = np.repeat(np.arange(n), sizes)
    good = sizes > 0
    good[doc[counts[codes] == 0]] = False
    ends = np.cumsum(sizes)
    sums = {}
    for c in SUMS:
        each = upto[c][last] - upto[c][last - counts]
        total = np.concatenate([[0], np.cumsum(each[codes])])
        sums[c] = np.where(good, total[ends] - total[ends - sizes], 0)
    digests, texts, at_end = [], [], ends.tolist()
    for d, (end, size) in enumerate(zip(at_end, sizes.tolist())):
        text = ";".join(map(names.__getitem__, codes[end - size : end].tolist())) if good[d] else ""
        digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        if with_groups:
            texts.append(text)
    del names

    pairs, at = np.unique(flat, return_inverse=True)
    span = max(len(pairs), 1)
    # A range of documents at a time, as their (document, pair) rows are many.
    keys, weights, first = [], [], 0
    while first < n:
        begin = int(ends[first] - sizes[first])
        stop = max(first + 1, int(np.searchsorted(ends, begin + RANGE, "right")))
        some = slice(begin, int(ends[stop - 1]))
        held, times = np.unique((doc[some] * width + codes[some])[good[doc[some]]], return_counts=True)
        who, seg = np.divmod(held, width)
        each = counts[seg]
        link = np.repeat(last[seg] - np.cumsum(each), each) + np.arange(int(each.sum()))
        key = np.repeat(who, each) * span + at[link]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], np.repeat(times, each)[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        keys.append(key[new])
        weights.append(np.add.reduceat(weight, new) if len(new) else weight)
        first = stop
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    docs = np.bincount(key % span, minlength=len(pairs))
    there = docs > 0  # those of texts without tokens only are in no document
    key = key // span * max(int(there.sum()), 1) + (np.cumsum(there) - 1)[key % span] if len(key) else key
    row = {
        "block": block["whose"], "ids": block["ids"], **{c: pa.array([v]) for c, v in sums.items()}, "groups_sha256": pa.array([digests]), "n_pairs": pa.array([int(there.sum())]),
        "pairs": pa.array([_squeeze(np.diff(pairs[there], prepend=0))]), "docs": pa.array([_squeeze(docs[there])]),
        "key": pa.array([_squeeze(np.diff(key, prepend=0))]), "weight": pa.array([_squeeze(np.concatenate(weights) if weights else key)]),
    }
    return pa.table(row | ({"groups": pa.array([texts])} if with_groups else {}))


PAIRS = "bucket int, kind int, block long, pairs binary, docs binary, best binary"
ANSWER = "block long, bucket int, docs binary, best binary"


def _bucket_of(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pairs by the bucket of their A id, and where each bucket begins."""
    to = ((pairs >> SHIFT) * 0x9E3779B1 >> 7) % buckets
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1))


def dealt_pairs(made: DataFrame, buckets: int) -> DataFrame:
    """Each block's pairs by bucket of their A id, a row for each block and bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                pairs, docs = np.cumsum(_spread(row["pairs"])), _spread(row["docs"])
                order, bounds = _bucket_of(pairs, buckets)
                for bucket, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if x < y:
                        mine = order[x:y]
                        yield _batch(PAIRS, [(bucket, 1, row["block"], _squeeze(np.diff(pairs[mine], prepend=0)), _squeeze(docs[mine]), None)])

    return made.select("block", "pairs", "docs").mapInArrow(run, PAIRS)


def total_pairs(dealt: DataFrame, buckets: int) -> DataFrame:
    """The sum over all blocks of each pair, and whether none of its A id has more: a row a bucket.
    A task holds one bucket's distinct pairs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([d for _, d in held])).astype(np.int64)

        def close() -> pa.RecordBatch:
            pairs, docs = merged()
            first = np.flatnonzero(np.diff(pairs >> SHIFT, prepend=-1))
            most = np.repeat(np.maximum.reduceat(docs, first), np.diff(np.append(first, len(pairs))))
            return _batch(PAIRS, [(now, 0, -1, _squeeze(np.diff(pairs, prepend=0)), _squeeze(docs), _squeeze((docs == most).astype(np.int64)))])

        for part in parts:
            for row in part.to_pylist():
                if row["bucket"] != now:
                    if held:
                        yield close()
                    now, held = row["bucket"], []
                held.append((np.cumsum(_spread(row["pairs"])), _spread(row["docs"])))
                if sum(len(p) for p, _ in held[1:]) > max(1 << 20, len(held[0][0])):
                    held = [merged()]
        if held:
            yield close()

    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, PAIRS)


def answered(totals: DataFrame, dealt: DataFrame, buckets: int) -> DataFrame:
    """Each block's pairs with their totals: in each bucket's stream its totals come first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = docs = best = None
        for part in parts:
            for row in part.to_pylist():
                mine = np.cumsum(_spread(row["pairs"]))
                if row["kind"] == 0:
                    pairs, docs, best = mine, _spread(row["docs"]), _spread(row["best"])
                else:
                    at = np.searchsorted(pairs, mine)
                    yield _batch(ANSWER, [(row["block"], row["bucket"], _squeeze(docs[at]), _squeeze(best[at]))])

    both = totals.unionByName(dealt)
    return both.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, ANSWER)


def _count(answers: pa.Table, block: pa.Table, buckets: int, extra: Sequence[str]) -> pa.Table:
    """One block's documents with the counts of their links, one row each."""
    pairs = np.cumsum(_spread(block["pairs"][0].as_py()))
    order, bounds = _bucket_of(pairs, buckets)
    per, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for r in answers.to_pylist():
        mine = order[bounds[r["bucket"]] : bounds[r["bucket"] + 1]]
        per[mine], best[mine] = _spread(r["docs"]), _spread(r["best"])
    ids = block["ids"].combine_chunks().flatten()
    key, weight = np.cumsum(_spread(block["key"][0].as_py())), _spread(block["weight"][0].as_py())
    width = max(len(pairs), 1)
    ends = np.searchsorted(key, np.arange(len(ids) + 1) * width)

    def total(v: np.ndarray) -> pa.Array:
        up = np.concatenate([[0], np.cumsum(v[key % width] * weight)]) if len(v) else np.zeros(len(key) + 1, np.int64)
        return pa.array(up[ends[1:]] - up[ends[:-1]], pa.int64())

    same = {c: block[c].combine_chunks().flatten() for c in (*SUMS, "groups_sha256", *extra)}
    return pa.table({"doc_id": ids, **same, "n_best": total(best), "count_sum": total(per)})


@dataclass(frozen=True)
class Aligned:
    """``documents``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (and groups, if asked for),
    n_best, count_sum. ``pairs``: a, b, docs (documents with the link), best (none of a's others has more)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False, block_bytes: int = BLOCK_BYTES) -> Aligned:
    """Align both tokenizers' tokens of all texts."""
    require_columns(docs, [doc_id, text])
    id_type = docs.schema[doc_id].dataType
    spark = docs.sparkSession
    blocks = materialise(blocks_of(docs, doc_id, text, safe_spaces(a_path, b_path), block_bytes), "align-blocks")

    def parts_for(rows: DataFrame, column: str) -> int:
        n = rows.agg(F.sum(column)).first()[0] or 0
        return max(min(4 * spark.sparkContext.defaultParallelism, 1 + n // 1000), -(-n // BUCKET))

    buckets = parts_for(blocks, "n_keys")
    linked = align_keys(dealt_keys(blocks, buckets), buckets, a_path, b_path)

    extra = ["groups"] if groups else []
    texts, longs = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    composed = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(c, longs) for c in SUMS], T.StructField("groups_sha256", texts),
        T.StructField("n_pairs", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("pairs", "docs", "key", "weight")], *[T.StructField(c, texts) for c in extra],
    ])

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compose(left, right, groups).select(composed.names)

    kept = blocks.select(F.col("block").alias("whose"), "ids", "sizes", "codes")
    made = materialise(linked.groupBy("block").cogroup(kept.groupBy("whose")).applyInArrow(compose, composed), "align-documents")

    buckets_2 = parts_for(made, "n_pairs")
    dealt = dealt_pairs(made, buckets_2)
    totals = materialise(total_pairs(dealt, buckets_2), "align-pairs")
    answers = answered(totals, dealt, buckets_2)
    out = T.StructType([
        T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in SUMS], T.StructField("groups_sha256", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in extra], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
    ])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        return _count(left, right, buckets_2, extra).select(out.names)

    slim = made.select(F.col("block").alias("whose"), *[c for c in made.columns if c not in ("block", "docs", "n_pairs")])
    documents = answers.groupBy("block").cogroup(slim.groupBy("whose")).applyInArrow(count, out)

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                pairs = np.cumsum(_spread(row["pairs"]))
                cols = [pa.array(pairs >> SHIFT), pa.array(pairs & ((1 << SHIFT) - 1)), pa.array(_spread(row["docs"])), pa.array(_spread(row["best"]) > 0)]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "docs", "best"])

    return Aligned(documents, totals.mapInArrow(spread, "a long, b long, docs long, best boolean"))
