"""Nearest neighbours by score-aware anisotropic quantisation.

A vector x with its half squared norm appended, (x, -|x|^2/2), makes the nearest vector to q in
Euclidean distance the one of largest inner product with (q, 1). Vectors are product-quantised
with 16 centroids for each pair of dimensions. What distorts an inner product of interest is the
part of the residual parallel to the vector itself, so centroids and codes minimise
``eta`` |parallel|^2 + |orthogonal|^2 with eta above one: codes are chosen by coordinate descent
over the subspaces, centroids by solving the weighted least squares of their members.

The index holds every row: two four-bit codes a byte, in blocks. A query's scores against a
part are sums of table rows, one 256-entry table for each byte. Codes whose score comes within
``margin`` of the part's ``candidates``-th best (however many: crowds of near copies share codes)
are scored again with their residuals, a signed byte for each dimension at a scale of the vector's own.
The best ``candidates`` of these, over all parts, are reranked by the exact distance on the original
vectors. The margin is MARGIN standard deviations of the codes' error, taken from the sample.

Copies of one vector beyond the first ``k`` + 1 (by id) cannot be among any query's nearest, so
they are left out of the index; crowds of copies cannot fill a candidate list.

Vectors null, of zero length, all zero, or with null or non-finite components take no part, nor
do vectors of another size than the commonest one (ties: the smaller). Ties go to the smaller
id. With fewer than k candidates all are returned; an empty table gives no rows. Of rows that
share an id the one of the least vector (element by element) stands. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.llm.common import materialise, require_columns

#: Rows the codebooks are fitted on: those of smallest hashed ids.
SAMPLE = 20_000
ETA = 3.0
CENTROIDS = 16
BLOCK = 4096
#: Queries that meet a part's codes in one task: codes are shuffled once for each so many.
QUERY_BLOCK = 1 << 14
CANDIDATES = 120
MARGIN = 3.0
PARTS_LEAST, PART_ROWS = 8, 1 << 20


@dataclass
class Codebook:
    centroids: np.ndarray  # subspaces x 16 x 2
    eta: float = ETA

    @property
    def width(self) -> int:
        return 2 * len(self.centroids)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of the padded rows: nearest centroids first, then coordinate descent on
        |r|^2 + (eta - 1) (r . x / |x|)^2, where r is the residual."""
        m = len(self.centroids)
        parts = x.reshape(len(x), m, 2)
        codes = np.empty((len(x), m), np.uint8)
        for s in range(m):
            codes[:, s] = ((parts[:, s, None, :] - self.centroids[s]) ** 2).sum(2).argmin(1)
        norm = np.sqrt((x**2).sum(1, keepdims=True))
        unit = (x / np.maximum(norm, 1e-30)).reshape(len(x), m, 2)
        at = np.arange(len(x))
        pull = sum(((parts[:, s] - self.centroids[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(m))
        for _ in range(rounds):
            for s in range(m):
                r = parts[:, s, None, :] - self.centroids[s]
                along = (r * unit[:, s, None, :]).sum(2)
                rest = pull - along[at, codes[:, s]]
                loss = (r**2).sum(2) + (self.eta - 1) * (rest[:, None] + along) ** 2
                codes[:, s] = loss.argmin(1)
                pull = rest + along[at, codes[:, s]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: the score of both codes of a byte."""
        m = len(self.centroids)
        lut = np.einsum("qmd,mcd->qmc", queries.reshape(len(queries), m, 2), self.centroids).astype(np.float32)
        low, high = lut[:, 0::2], lut[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), m // 2, 256)


    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centroids[s][codes[:, s]] for s in range(len(self.centroids))], 1)


def residuals(x: np.ndarray, coded: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A signed byte for each dimension, each row's scale, and what turns the codes' score into the
    one of the refined vector y: q . y - |y|^2 / 2."""
    rest = (x - coded)[:, :dims]
    scale = (np.abs(rest).max(1) / 127).astype(np.float32)
    small = np.round(rest / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
    y = coded[:, :dims] + small * scale[:, None].astype(np.float64)
    return small, scale, (-coded[:, dims] - 0.5 * (y**2).sum(1)).astype(np.float32)


def score_error(book: Codebook, vectors: np.ndarray) -> float:
    """Standard deviation of the codes' error in a score, each row asked for by another one."""
    x = padded(vectors)
    asked = padded(np.roll(vectors, 1, axis=0), np.ones(len(vectors)))
    return float((asked * (x - book.decode(book.encode(x)))).sum(1).std())


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def padded(x: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Rows with one more dimension, padded to a multiple of four."""
    n, d = x.shape
    out = np.zeros((n, -(-(d + 1) // 4) * 4))
    out[:, :d] = x
    out[:, d] = -0.5 * (x**2).sum(1) if last is None else last
    return out


def fit(x: np.ndarray, rounds: int = 8, seed: int = 5, eta: float = ETA) -> Codebook:
    """Codebooks for the rows of x (already padded)."""
    rng = np.random.default_rng(seed)
    m = x.shape[1] // 2
    parts = x.reshape(len(x), m, 2)
    start = parts[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)]
    book = Codebook(start.transpose(1, 0, 2) + rng.normal(0, 1e-6, (m, CENTROIDS, 2)), eta)
    for _ in range(rounds):  # plain product quantisation first
        for s in range(m):
            code = ((parts[:, s, None, :] - book.centroids[s]) ** 2).sum(2).argmin(1)
            count = np.bincount(code, minlength=CENTROIDS)
            total = np.stack([np.bincount(code, parts[:, s, d], CENTROIDS) for d in (0, 1)], 1)
            book.centroids[s] = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book.centroids[s])
    unit = (x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-30)).reshape(len(x), m, 2)
    for _ in range(3):  # then the weighted loss: codes, and the centroids that minimise it
        codes = book.encode(x, 1)
        pull = sum(((parts[:, s] - book.centroids[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(m))
        for s in range(m):
            c, u = codes[:, s], unit[:, s]
            own = ((parts[:, s] - book.centroids[s][c]) * u).sum(1)
            rest = pull - own
            # For each centroid: sum (I + (eta-1) u u^T) c = sum x + (eta-1) u (rest + u.x)
            want = parts[:, s] + (eta - 1) * u * (rest + (u * parts[:, s]).sum(1))[:, None]
            left = np.eye(2) + (eta - 1) * u[:, :, None] * u[:, None, :]
            for k in range(CENTROIDS):
                rows = c == k
                if rows.any():
                    book.centroids[s][k] = np.linalg.solve(left[rows].sum(0), want[rows].sum(0))
            pull = rest + ((parts[:, s] - book.centroids[s][c]) * u).sum(1)
    return book


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): the vectors that take part, of one size."""
    require_columns(vectors, [vec_id, embedding])
    v = F.col(f"`{embedding}`").cast("array<double>")
    # NaN counts as larger than any number in Spark, so it fails the upper bound.
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= np.finfo(np.float64).max))
    some = F.exists(v, lambda x: x != 0)
    got = vectors.where(F.col(f"`{vec_id}`").isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))
    got = got.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
    sizes = got.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return got.where(F.size("v") == (sizes[0]["n"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best places of a row of scores; ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        tied = tied[np.argsort(ids[tied], kind="stable")][: k - len(sure)]
        return np.concatenate([sure, tied])
    return np.arange(len(scores))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    candidates: int = CANDIDATES, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance.

    ``is_query`` is a condition on the column ``id``. Queries go in blocks of QUERY_BLOCK rows;
    each block of codes meets each block of queries once, so the codes (half a byte for each
    dimension) are shuffled once for each block of queries.
    """
    spark = vectors.sparkSession
    clean = materialise(usable(vectors, vec_id, embedding), "vectors")
    few = clean.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select("id", "v").collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not few:
        return spark.createDataFrame([], empty)
    x = np.array([r["v"] for r in sorted(few, key=lambda r: (r["id"], r["v"]))])
    scale = float(np.sqrt((x**2).sum(1).mean())) or 1.0
    fitted = fit(padded(x / scale))
    margin = MARGIN * score_error(fitted, x / scale)
    book = spark.sparkContext.broadcast(fitted)

    copies = Window.partitionBy("v").orderBy("id")
    index = clean.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, BLOCK):
                few = part.slice(i, BLOCK)
                x = matrix(few.column(1)) / scale
                wide = padded(x)
                codes = book.value.encode(wide)
                small, sizes, lift = residuals(wide, book.value.decode(codes), x.shape[1])
                cells = (np.asarray(few.column(0)).astype("<i8"), pack(codes), small, np.stack([sizes, lift], 1).astype("<f4"))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["ids", "codes", "rest", "sizes"])

    blocks = index.select("id", "v").mapInArrow(encode, "ids binary, codes binary, rest binary, sizes binary")
    queries = clean.where(is_query).select("id", "v")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(n_blocks)).cast("int"))

    def pack_queries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.asarray(part.column(0))
            for b in np.unique(at):
                rows = part.take(pa.array(np.flatnonzero(at == b)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(b)], pa.int32()), pa.array([np.asarray(rows.column(1)).astype("<i8").tobytes()], pa.binary()), pa.array([matrix(rows.column(2)).astype("<f8").tobytes()], pa.binary())],
                    names=["block", "ids", "codes"],
                )

    asked = queries.select("block", "id", "v").mapInArrow(pack_queries, "block int, ids binary, codes binary")
    # A part holds about PART_ROWS codes. Each returns a list for each query, so there are no
    # more parts than that; many queries make many blocks, which run side by side.
    slices = max(PARTS_LEAST, -(-clean.count() // PART_ROWS))
    sent = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("block", "part", F.lit(False).alias("q"), "ids", "codes", "rest", "sizes")
    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("block", "part", F.lit(True).alias("q"), "ids", "codes", F.lit(None).cast("binary").alias("rest"), F.lit(None).cast("binary").alias("sizes"))

    def search(got: pa.Table) -> pa.Table:
        is_q = np.array(got.column("q").to_pylist(), bool)
        ids, data = got.column("ids").to_pylist(), got.column("codes").to_pylist()
        q_id = np.frombuffer(b"".join(ids[i] for i in np.flatnonzero(is_q)), "<i8")
        c_id = np.frombuffer(b"".join(ids[i] for i in np.flatnonzero(~is_q)), "<i8")
        out_q, out_c, out_s = [], [], []
        if len(q_id) and len(c_id):
            q = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(is_q)), "<f8").reshape(len(q_id), -1) / scale
            codes = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(~is_q)), np.uint8).reshape(len(c_id), -1)
            mine = np.flatnonzero(~is_q)
            rest, sizes = (got.column(n).to_pylist() for n in ("rest", "sizes"))
            small = np.frombuffer(b"".join(rest[i] for i in mine), np.int8).reshape(len(c_id), -1)
            size, lift = np.frombuffer(b"".join(sizes[i] for i in mine), "<f4").reshape(-1, 2).T
            by_byte = np.ascontiguousarray(codes.T)
            wide = padded(q, np.ones(len(q)))
            asked = q.astype(np.float32)
            for i in range(0, len(q), 16):
                lut = book.value.tables(wide[i : i + 16])
                for j, table in enumerate(lut, i):
                    score = np.zeros(len(c_id), np.float32)
                    for row, byte in zip(table, by_byte):
                        score += row[byte]
                    # All near the cut, then their scores with the residuals.
                    cut = np.partition(score, -candidates - 1)[-candidates - 1] - margin if len(score) > candidates + 1 else -np.inf
                    close = np.flatnonzero(score >= cut)
                    fine = score[close] + (small[close] @ asked[j]) * size[close] + lift[close]
                    best = top(fine, c_id[close], candidates + 1)
                    out_q.append(np.full(len(best), q_id[j]))
                    out_c.append(c_id[close[best]])
                    out_s.append(fine[best])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_c, np.int64), "near": cat(out_s, np.float64)})

    found = sent.unionByName(spread).groupBy("block", "part").applyInArrow(search, "query_id long, vec_id long, near double")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    found = found.where("query_id != vec_id").withColumn("n", F.row_number().over(best)).where(F.col("n") <= candidates)
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    c = index.select(F.col("id").alias("vec_id"), F.col("v").alias("cv"))
    exact = found.select("query_id", "vec_id").distinct().join(c, "vec_id").join(q, "query_id")
    square = F.aggregate(F.zip_with("qv", "cv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
    exact = exact.select("query_id", "vec_id", F.sqrt(square).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
