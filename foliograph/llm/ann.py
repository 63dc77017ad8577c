"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length 1, filled up with zeros to at least ``BITS``
components, since bounds narrow with the root of the code's length, and turned
by one random rotation; a code keeps
the sign of each coordinate in packed bits, with one correction scalar: the
inner product of the turned vector and its own sign vector. From bits and
scalar follows an unbiased estimate of the cosine with a query and a bound of
its error that a fresh query exceeds rarely. Per query, vectors whose upper
bound reaches the k-th largest lower bound are reranked by the exact cosine.

Queries go in blocks of bounded size over all partitions of the vectors: a
partition returns its k best per query, written before the next block is read,
so the driver holds one block at a time; a ranking per query joins them.
Queries times vectors bit products are counted, whatever the data look like:
coarse cells were measured on the given vectors, which have no clusters, and
half of the cells had to be read for a recall of 0.9.

Defined results: vectors null, empty, zero, or with null or non-finite
components take no part, neither as queries nor as candidates; vectors of
different lengths aren't compared; ties go to the smaller vec_id; of rows
repeated with one vec_id the nearest counts once; a query's own vec_id is no candidate.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import table

#: Queries of a block: 8 MB of doubles at 64 dimensions.
BLOCK = 16384
#: Least length of a code.
BITS = 256
#: Error bounds in standard deviations of the estimate.
EPSILON = 4.0
OUT = "query_id long, vec_id long, score double"


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


@functools.lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """The first ``dims`` rows of a random rotation of the space of codes; the others meet zeros."""
    n = max(dims, BITS)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return (q * np.sign(np.diag(r)))[:dims].astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors by the power of two that brings their largest component to 0.5 to 1: squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(-1))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars) of scaled vectors."""
    turned = (vectors / lengths(vectors)[:, None]).astype(np.float32) @ turn
    correction = np.abs(turned).sum(1, dtype=np.float64) / np.sqrt(turn.shape[1])
    return np.packbits(turned >= 0, axis=1), np.minimum(correction, 1)


def estimate(bits: np.ndarray, correction: np.ndarray, queries: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of cosines: queries (turned, length 1) by codes."""
    n = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=n).astype(np.float32) * 2 - 1
    signs /= (correction * np.sqrt(n)).astype(np.float32)[:, None]
    error = epsilon * np.sqrt(1 - correction**2) / correction / np.sqrt(max(1, n - 1))
    return queries @ signs.T, error.astype(np.float32)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; the same for equal vectors wherever they stand."""
    query, vectors = scaled(query), scaled(vectors)
    return (vectors * query).sum(1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(1)))


class _Queries:
    """The queries of one length, and the best found for each."""

    def __init__(self, ids: list[int], vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = np.array(ids), scaled(vectors), k
        self.lengths = lengths(self.vectors)
        self.turn = rotation(vectors.shape[1])
        self.turned = (self.vectors / self.lengths[:, None]).astype(np.float32) @ self.turn
        self.best: list[dict[int, float]] = [{} for _ in ids]
        #: The k-th best score found so far, of different ids.
        self.floor = np.full(len(ids), -np.inf)

    def rank(self, ids: np.ndarray, vectors: np.ndarray, epsilon: float) -> None:
        """Updates the best with a block of vectors."""
        vectors = scaled(vectors)
        own = lengths(vectors)
        codes = encode(vectors, self.turn)
        for at in range(0, len(self.ids), 256):
            part = slice(at, at + 256)
            est, err = estimate(*codes, self.turned[part], epsilon)
            if np.isinf(self.floor[part]).any():
                lower = np.where(ids == self.ids[part, None], -np.inf, est - err)
                # the best by estimate first, so that bounds are held against exact scores
                top = np.argpartition(lower, -min(8 * self.k, len(ids)), axis=1)[:, -min(8 * self.k, len(ids)) :]
                self._rerank(np.repeat(np.arange(len(est)), top.shape[1]) + at, top.ravel(), ids, vectors, own)
            least = self.floor[part]
            est += err
            q, v = np.nonzero(est >= (least - 1e-5).astype(np.float32)[:, None])
            for i in range(0, len(q), 2048):
                self._rerank(q[i : i + 2048] + at, v[i : i + 2048], ids, vectors, own)

    def _rerank(self, q, v, ids, vectors, own) -> None:
        scores = (vectors[v] * self.vectors[q]).sum(1) / (self.lengths[q] * own[v])
        keep = (scores >= self.floor[q]) & (ids[v] != self.ids[q])
        for i, vec_id, score in zip(q[keep].tolist(), ids[v[keep]].tolist(), scores[keep].tolist(), strict=True):
            found = self.best[i]
            if score > found.get(vec_id, -np.inf):
                found[vec_id] = score
                if len(found) > self.k:
                    del found[max(found, key=lambda x: (-found[x], x))]
                if len(found) == self.k:
                    self.floor[i] = min(found.values())


def _search(queries: list[tuple[int, np.ndarray]], k: int, epsilon: float):
    by_dims: dict[int, list] = {}
    for i, v in queries:
        by_dims.setdefault(len(v), []).append((i, v))

    def search(batches):
        asked = {dims: _Queries([i for i, _ in own], np.stack([v for _, v in own]), k) for dims, own in by_dims.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
            for dims, own in asked.items():
                rows = np.flatnonzero(sizes == dims)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    own.rank(ids[part], flat[(ends[part] - dims)[:, None] + np.arange(dims)], epsilon)
        out = [(q, i, s) for own in asked.values() for q, found in zip(own.ids.tolist(), own.best, strict=True) for i, s in found.items()]
        if out:
            q, i, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query by cosine."""
    spark = vectors.sparkSession
    clean = vectors.filter(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.filter(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = table(asked.dropDuplicates(["vec_id"]), "queries")
    blocks = -(-asked.count() // block)
    found = None
    for b in range(blocks):
        # a block is bounded by its number of vectors; its rows are written before the next one is read
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        one = clean.mapInArrow(_search([(r["vec_id"], np.array(r["v"])) for r in part], k, epsilon), OUT)
        one = table(one, "found")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], OUT)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e, e.filter("vec_id % 50 = 0"))
