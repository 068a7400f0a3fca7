"""Quality scores by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it (chunks of ``CHUNK``
bytes every ``STEP`` bytes; the last ends with the text; a shorter text is one chunk padded with
NUL). Learned filters four bytes wide move over each chunk byte by byte; each filter's largest
response in the chunk, cut off below zero, goes into a linear layer, and the mean of the
chunks' outputs through the logistic function is the text's probability of label 1.

A filter's response to four bytes is the sum of two table rows looked up by byte pairs, so
scoring is two gathers, one sum and one maximum a chunk.

Training (on the driver) takes a bounded sample of labelled documents, in the order of their
hashed ids: at most ``PER_CLASS`` of each class and ``SAMPLE_BYTES`` of text in all, half for each
class; a text that no longer fits is passed over. Sampled texts are learned from whole, pooled as
they are scored. Examples are weighted back to the labels' shares, so the score is a probability.
Null texts count as empty, and empty texts are scored like any other. Null labels are not learned
from; repeated labels count as often as they stand there. With labels of one class only, or none,
every score is that class's share (0.5 for none); the same holds if no labelled document of a class
is there. Ids are compared as text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.common import require_columns, utf8

CHUNK, STEP = 512, 448
WIDTH, FILTERS = 4, 16
PER_CLASS, SAMPLE_BYTES = 1200, 12 << 20
#: Documents a step, and chunks that are held at once.
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
HELD = 512
#: Few examples are gone over more often, for this many steps at least.
STEPS = 400


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float

    def __post_init__(self) -> None:
        self._tables: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"filters": self.filters, "bias": self.bias, "out": self.out, "shift": self.shift, "_tables": None}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to each byte pair in the first and in the second half of a filter."""
        if self._tables is None:
            w = self.filters.astype(np.float32)
            # A pair read as a little-endian integer has its first byte in the low eight bits.
            first = (w[1][:, None, :] + w[0][None, :, :]).reshape(65536, -1)
            second = (w[3][:, None, :] + w[2][None, :, :]).reshape(65536, -1) + self.bias.astype(np.float32)
            self._tables = first, second
        return self._tables

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        """One output for each row of CHUNK bytes."""
        out = np.empty(len(chunks), np.float64)
        for i in range(0, len(chunks), 64):
            top, _ = self.responses(chunks[i : i + 64])
            out[i : i + 64] = np.maximum(top, 0) @ self.out + self.shift
        return out

    def responses(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest response in each chunk, and where it is."""
        first, second = self.tables()
        wide = chunks.astype(np.uint16)
        pairs = wide[:, :-1] | (wide[:, 1:] << 8)
        y = first[pairs[:, :-2]]
        y += second[pairs[:, 2:]]
        if not places:
            return y.max(1), None
        best = y.argmax(1)
        return np.take_along_axis(y, best[:, None, :], 1)[:, 0], best

    def scores(self, texts: list[bytes], block: int = 4096) -> np.ndarray:
        """The probability of label 1 for each whole text."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                got, who = self.logits(np.concatenate(held)), np.concatenate(owner)
                np.add.at(sums, who, got)
                np.add.at(counts, who, 1)
                held.clear()
                owner.clear()
                size = 0

        for k, t in enumerate(texts):
            starts = chunk_starts(len(t))
            for i in range(0, len(starts), block):
                rows = chunk_rows(t, starts[i : i + block])
                held.append(rows)
                owner.append(np.full(len(rows), k))
                size += len(rows)
                if size >= block:
                    flush()
        flush()
        return sigmoid(sums / np.maximum(counts, 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes, with the last one ending at the end."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - CHUNK, STEP), n - CHUNK)


def chunk_rows(text: bytes, starts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < CHUNK:
        raw = np.concatenate([raw, np.zeros(CHUNK - len(raw), np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Network:
    """Weighted logistic loss of whole texts by Adam. A text's output is the mean over its chunks;
    the gradient reaches the winning place of each filter in each chunk."""
    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS),
        rng.choice([-0.3, 0.3], FILTERS), np.array([0.0]),
    ]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = [chunk_rows(t, chunk_starts(len(t))) for t in texts]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            net = Network(*params[:3], float(params[3][0]))
            x = np.concatenate([rows[d] for d in docs])
            owner = np.repeat(np.arange(len(docs)), [len(rows[d]) for d in docs])
            share = 1 / np.bincount(owner)[owner]
            top, best = (np.concatenate(a) for a in zip(*(net.responses(x[j : j + HELD], True) for j in range(0, len(x), HELD))))
            h = np.maximum(top, 0).astype(np.float64)
            logit = np.bincount(owner, share * (h @ params[2])) + params[3][0]
            error = ((sigmoid(logit) - labels[docs]) * weights[docs] / len(docs))[owner] * share
            back = error[:, None] * params[2] * (top > 0)
            grads = [np.zeros_like(params[0]), back.sum(0), h.T @ error, np.array([error.sum()])]
            for k in range(WIDTH):
                byte = np.take_along_axis(x, best + k, 1)
                np.add.at(grads[0][k], (byte, np.arange(FILTERS)), back)
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) + RATE * DECAY * p
    return Network(*params[:3], float(params[3][0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def constant(share: float) -> Network:
    """Every text scores the share."""
    logit = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return Network(np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.zeros(FILTERS), logit)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on a bounded sample of the labelled rows that are not held out.

    At most 2 x per_class ids and lengths are sent about, and at most ``sample_bytes`` come back.
    """
    require_columns(docs, ["doc_id", "text"])
    require_columns(labels, ["doc_id", label])
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(totals) < 2:
        return constant(float(next(iter(totals))) if totals else 0.5)
    order = F.xxhash64("id", F.lit(11))
    sample = [r for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy(order, "id").limit(per_class).collect()]
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), utf8("text").alias("raw"))

    def chosen(rows: list, fields: str) -> DataFrame:
        return texts.join(F.broadcast(docs.sparkSession.createDataFrame(rows, fields)), "id")

    sizes = chosen(sample, "id string, y int").select("id", "y", F.length("raw").alias("n"), F.xxhash64("raw").alias("mark"), order.alias("o")).collect()
    room, taken = {0: sample_bytes // 2, 1: sample_bytes // 2}, []
    for r in sorted(sizes, key=lambda r: (r["o"], r["id"], r["y"], r["mark"])):
        if r["n"] <= room[r["y"]]:
            room[r["y"]] -= r["n"]
            taken.append((r["id"], r["y"], r["mark"]))
    if len({y for _, y, _ in taken}) < 2:
        return constant(totals[1] / (totals[0] + totals[1]))
    times = {}
    for t in taken:
        times[t] = times.get(t, 0) + 1
    rows = chosen(list(times), "id string, y int, mark long").where(F.xxhash64("raw") == F.col("mark")).select("id", "y", "mark", "raw").collect()
    got = sorted({(r["id"], r["y"], r["mark"]): bytes(r["raw"]) for r in rows}.items())
    y = np.array([k[1] for k, _ in got], np.float64)
    each = np.array([float(times[k]) for k, _ in got])
    for c in (0, 1):
        each[y == c] *= totals[c] / each[y == c].sum()
    return train([t for _, t in got], y, each / each.mean())


def score(docs: DataFrame, network: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Add the column ``out``; all other columns stay as they are. A map over partitions."""
    require_columns(docs, [text])
    sent = docs.sparkSession.sparkContext.broadcast(network)
    names = [c for c in docs.columns if c != out]
    plain = docs.select(*[F.col(f"`{c}`") for c in names], utf8(f"`{text}`").alias("raw")).toDF(*[f"c{i}" for i in range(len(names) + 1)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for part in parts:
            got = net.scores(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.float64())], names=[*part.schema.names[:-1], "score"])

    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*names, out)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents with a score of at least the threshold; the columns stay as they are,
    whatever their names."""
    names = docs.columns
    got = score(docs, fit(docs, labels), out="\0score")
    return got.where(F.col("`\0score`") >= threshold).select(*[F.col(f"`{c}`") for c in names])
