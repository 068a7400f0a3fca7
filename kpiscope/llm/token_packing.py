"""Token ids in fixed-width bit-packed shards.

A shard is one binary value that stands by itself:

    magic ``KPT1`` | bits u32 | block u32 | n_docs u64 | n_null u64 | n_tokens u64 | n_blocks u64
    | doc_id i64 x n_docs | end of each document's ids u64 x n_docs
    | byte offset of each block u64 x n_blocks | blocks

A block holds ``block`` ids (the last one fewer) of ``bits`` bits each, lowest bit first,
padded to whole bytes; ``bits`` is the least that holds the vocabulary. Block offsets give
random access, and unpacking is one numpy gather. The first ``n_null`` documents have no id.

Shards are rows of a Parquet table (written by Spark, so that any store works and lost
executors cost only their tasks), ordered by (part, seq). Documents are dealt by ranges of
doc_id, so shards in that order hold all documents in ascending doc_id order (null first, ties by a hash of
the text, then by the text), the same on each run. Ids are integers; others are refused.
Null and empty texts hold only the end id; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kpiscope.llm.chunks import ChunkEncoder, batches, text_of
from kpiscope.llm.common import new_path, require_columns, utf8

MAGIC = b"KPT1"
HEAD = struct.Struct("<4sIIQQQQ")
BLOCK = 4096
#: A shard is closed at so many ids (8 MB at 16 bits).
SHARD_TOKENS = 1 << 22


def min_bits(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits of each id, lowest first, padded to whole bytes."""
    if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    padded = np.frombuffer(bytes(raw) + b"\0" * 8, np.uint8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at = np.arange(n, dtype=np.int64) * bits
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def build_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    nulls = sum(d is None for d in doc_ids)
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), nulls, len(ids), len(blocks))
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.cumsum(counts).astype("<u8").tobytes(),
        offsets.astype("<u8").tobytes(), *blocks,
    ])


class Shard:
    """Random access to one shard's ids."""

    def __init__(self, raw: bytes) -> None:
        magic, self.bits, self.block, n_docs, self.nulls, self.n_tokens, n_blocks = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a packed shard")
        at = HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        self.ends = np.frombuffer(raw, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks, at + 16 * n_docs).astype(np.int64)
        self.data = memoryview(raw)[at + 16 * n_docs + 8 * n_blocks :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, reading only the blocks that hold them."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        if start == end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_tokens - b * self.block)
            parts.append(unpack(self.data[self.offsets[b] : self.offsets[b] + (n * self.bits + 7) // 8], n, self.bits))
        got = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return got[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def __len__(self) -> int:
        return len(self.doc_ids)


class _Library:
    """The tokenizers library over the parts of texts, many parts a call."""

    GROUP = 2000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        from kpiscope.llm.bpe_segment import byte_alphabet

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        alphabet = byte_alphabet()
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.byte_len = np.zeros(self.size, np.int64)
        for word, i in self.tok.get_vocab().items():
            self.byte_len[i] = len(word.encode()) if word in special else sum(c in alphabet for c in word)
        self.encoder = ChunkEncoder(self.encode_keys)

    def encode_keys(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts that follow a space or line feed are encoded as one long text, in which they
        are apart by the same rule; ids are dealt back by the bytes they stand for."""
        plain = [i for i, k in enumerate(keys) if k[:1] != "\r"]
        other = [i for i, k in enumerate(keys) if k[:1] == "\r"]
        counts, order, out = np.zeros(len(keys), np.int64), [], []
        groups = [plain[i : i + self.GROUP] for i in range(0, len(plain), self.GROUP)]
        texts = [[text_of(keys[i]) for i in g] for g in groups]
        for g, parts, e in zip(groups, texts, self.tok.encode_batch_fast(["".join(x) for x in texts], add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.byte_len[ids]), np.cumsum([len(p.encode()) for p in parts]), "right")
            counts[g] = np.diff(ends, prepend=0)
            order += g
            out.append(ids)
        for i in range(0, len(other), self.GROUP):
            g = other[i : i + self.GROUP]
            for j, e in zip(g, self.tok.encode_batch_fast([text_of(keys[k]) for k in g], add_special_tokens=False)):
                counts[j] = len(e.ids)
                order.append(j)
                out.append(np.array(e.ids, np.int64))
        if not out:
            return np.zeros(0, np.int32), counts
        flat, rows = np.concatenate(out), np.array(order)
        starts = np.zeros(len(keys), np.int64)
        starts[rows] = np.cumsum(counts[rows]) - counts[rows]
        ends = np.cumsum(counts)
        return flat[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]))].astype(np.int32), counts


@lru_cache(maxsize=2)
def library(path: str) -> _Library:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Library(path)


SHARDS = "part int, seq int, first_token long, n_docs long, n_tokens long, shard binary"


def write_shards(
    docs: DataFrame, vocab_path: str, end_id: int | None = 0, path: str | None = None,
    text: str = "text", doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS,
) -> str:
    """Encode all texts and write them as shards; returns the table's path.

    One shuffle: documents are dealt by ranges of doc_id, as many as the input has partitions.
    Each task encodes its range in order and closes a shard at ``shard_tokens`` ids.
    """
    require_columns(docs, [text, doc_id])
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise ValueError(f"{doc_id} must be an integer, as shards hold ids in 64 bits")
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    end = [] if end_id is None else [end_id]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, part_no = library(vocab_path), TaskContext.get().partitionId()
        bits = min_bits(lib.size)
        seq = first = 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, first, size, held
            ids = np.concatenate([h[2] for h in held])
            who, counts = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held])
            row = [part_no, seq, first, len(who), len(ids), build_shard(who, counts, ids, bits)]
            seq, first, size, held = seq + 1, first + len(ids), 0, []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "seq", "first_token", "n_docs", "n_tokens", "shard"])

        for part in parts:
            who, raw = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in batches(raw):
                flat, counts = lib.encoder([t.decode() for t in raw[a:b]])
                if end:
                    flat = np.insert(flat, np.cumsum(counts), end[0])
                    counts = counts + 1
                held.append((who[a:b], counts, flat.astype(np.uint32)))
                size += len(flat)
                if size >= shard_tokens:
                    yield close()
        if held:
            yield close()

    n = max(1, docs.rdd.getNumPartitions())
    dealt = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), utf8(f"`{text}`").alias("raw"))
    dealt = dealt.withColumn("mark", F.xxhash64("raw")).repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "raw").select("doc_id", "raw")
    dealt.mapInArrow(run, SHARDS).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``: the number of ids of all shards before each.

    Ids before each range of documents: one sum a range, added up by the driver (as many
    numbers as write tasks), as each range knows its shards' places within itself.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    sums = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part] = total
        total += n
    if not base:
        return shards.withColumn("start", F.lit(0).cast("long"))
    starts = F.lit(np.array([base.get(i, 0) for i in range(max(base) + 1)], np.int64).tolist()) if base else None
    return shards.withColumn("start", F.get(starts, F.col("part")).cast("long") + F.col("first_token"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens and the crc32 of its ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, raw in zip(part.column(0).to_pylist(), part.column(1)):
                shard = Shard(raw.as_buffer().to_pybytes())
                n = len(shard)
                begins = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
                crc = np.zeros(n, np.int64)
                for a in range(0, n, 1024):
                    b = min(n, a + 1024)
                    ids = shard.ids(int(begins[a]), int(shard.ends[b - 1])).astype("<u4")
                    for i in range(a, b):
                        crc[i] = zlib.crc32(ids[begins[i] - begins[a] : shard.ends[i] - begins[a]].tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids, pa.int64(), mask=np.arange(n) < shard.nulls), pa.array(begins + start),
                    pa.array(shard.ends - begins), pa.array(crc),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    got = read_shards(spark, path).select("start", "shard")
    return got.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
