"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes of BITS bits: turned by rotations learned so that coordinates are near their signs (iterative
quantisation; Gong and Lazebnik, 2011), one bit a coordinate, with as many rotations as fill the code. Before, candidates are
centred and get one more coordinate that makes their norms equal, so that the angle to a query ranks as the inner product does.

Codes are cut into substrings of 64 bits and every substring is indexed by its distinct values. If two codes differ in r bits or
fewer, some substring differs in r // substrings bits or fewer, so that the values within that distance in each index lead to
every code within r; their full distance is then checked, and what is left is ranked by the exact inner product (Norouzi, Punjani and
Fleet, 2012).

The rotations and the radius are fitted on a sample of at most SAMPLE vectors: the radius is the distance within which REACH of the
sample's own nearest neighbours lie, which is on the safe side, as neighbours among more vectors are nearer. Every vector is
indexed. Queries that have found fewer than k in all shards together are searched again with the radius that takes in all.

Queries come in blocks and vectors in shards of bounded size; each pair of a block and a shard is one group, and the k best of
each are merged. Blocks and shards are dealt by hash, so that no label or value gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import dots, kept_type, length_of, matrix, sample_of, usable

SAMPLE = 4096
REACH = 0.93
BITS = 256
#: Queries in a block and vectors in a shard, at most, about; shards are smaller where there are cores for more.
BLOCK = 16_384
SHARD, LEAST_SHARD = 65_536, 4096
FOUND = "query_id long, vec_id long, score double"


class Coder:
    """What turns vectors into codes of 64-bit words."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 11):
        self.mean = x.mean(axis=0)
        self.norm = np.linalg.norm(x - self.mean, axis=1).max()
        y, rng, turns, left = self._even(x), np.random.default_rng(seed), [], bits
        while left:
            turn = np.linalg.qr(rng.standard_normal((y.shape[1], y.shape[1])))[0][:, :left]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(y.T @ np.where(y @ turn >= 0, 1.0, -1.0), full_matrices=False)
                turn = u @ v
            turns.append(turn)
            left -= turn.shape[1]
        self.turn = np.concatenate(turns, axis=1)

    def _even(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        return np.c_[z, np.sqrt(np.maximum(0, self.norm**2 - (z * z).sum(axis=1)))]

    def _bits(self, y: np.ndarray) -> np.ndarray:
        return np.packbits(y @ self.turn >= 0, axis=1).view(np.uint64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._bits(self._even(x))

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self._bits(np.c_[x, np.zeros(len(x))])


def learn_radius(x: np.ndarray, coder: Coder, k: int, reach: float = REACH) -> int:
    """Bits within which `reach` of the k nearest of the sample's vectors lie."""
    c, q, near = coder.rows(x), coder.queries(x[:512]), []
    for i in range(min(len(x), 512)):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argpartition(-s, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else []
        near.append(np.bitwise_count(c[top] ^ q[i]).sum(axis=1))
    near = np.concatenate(near)
    return int(np.quantile(near, reach, method="higher")) if len(near) else c.shape[1] * 64


class MultiIndex:
    """Codes of a shard, with the distinct values of each substring and which of them each code has."""

    def __init__(self, c: np.ndarray):
        self.codes = c
        self.tables = [np.unique(c[:, j], return_inverse=True) for j in range(c.shape[1])]
        self.touched = 0

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from this one in radius bits or fewer; all of them, by the pigeonhole principle."""
        pieces, hit = len(self.tables), np.zeros(len(self.codes), bool)
        for j, (values, of) in enumerate(self.tables):
            # with `radius` spread over the pieces, one is at radius // pieces or less, and of the first ones at less if it is not whole
            most = radius // pieces if j <= radius % pieces else radius // pieces - 1
            if most >= 0:
                hit |= (np.bitwise_count(values ^ code[j]) <= most)[of]
        rows = np.flatnonzero(hit)
        self.touched += len(rows)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def search_shard(q_ids, q, q_codes, ids, x, c, k: int, radius: int):
    """(query id, id, score) of the k best of those within the radius of each query in one shard."""
    index = MultiIndex(c)
    out = []
    for i in range(len(q_ids)):
        rows = index.within(q_codes[i], radius)
        rows = rows[ids[rows] != q_ids[i]]
        rough = x[rows] @ q[i]
        if len(rows) > k:  # all that may be among the best once rounding is settled
            low = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= low - 1e-9 * (1 + abs(low))]
        s = dots(x[rows], q[i])
        b = np.lexsort((ids[rows], -s))[:k]
        out.append((np.full(len(b), q_ids[i]), ids[rows][b], s[b]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), kept_type(vectors, vector_col).alias("v")).filter(usable(F.col("v"))).filter("vec_id is not null")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by inner product, of each row whose id is divisible by `every`.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; nor do vectors of
    another length than most. A row is no candidate of its own id. Ties go to the smaller id. With fewer than k
    candidates all are returned. Repeated rows are found as often as they occur, a repeated query once. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = cut(_clean(vectors, id_col, vector_col), "usable")
    d = length_of(rows)
    if d is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == d)
    n = rows.count()
    x = np.array([r.v for r in sample_of(rows, SAMPLE, "vec_id", "v")], float)
    coder = Coder(x)
    radius = learn_radius(x, coder, k)

    def coded(code) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = code(matrix(batch.column(1))) if batch.num_rows else np.zeros((0, BITS // 64), np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(c), [None, pa.py_buffer(c.tobytes())]).cast(pa.binary())], ["vec_id", "v", "code"])

        return lambda df: df.mapInArrow(run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, code binary")

    index = cut(coded(coder.rows)(rows), "codes")
    asked = cut(coded(coder.queries)(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])), "queries")
    shards = max(-(-n // SHARD), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD)))

    def search(queries: DataFrame, radius: int) -> DataFrame:
        blocks = max(1, -(-queries.count() // BLOCK))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """One block of queries against one shard."""
            a, b = left.combine_chunks(), right.combine_chunks()
            q, v = (matrix(t.column("v").combine_chunks()) if t.num_rows else np.zeros((0, d)) for t in (a, b))
            words = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            found = search_shard(a.column("vec_id").to_numpy(), q, words(a), b.column("vec_id").to_numpy(), v, words(b), k, radius)
            return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

        many = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        parts = index.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return _ranked(many.groupBy("block", "shard").cogroup(parts.groupBy("block", "shard")).applyInArrow(run, FOUND), k)

    found = cut(search(asked, radius), "found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = cut(asked.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        again = search(short, BITS)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found


def recall(vectors: DataFrame, found: DataFrame, k: int = 20, every: int = 20, queries: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Audit: the share of the true k nearest of a bounded number of queries, the first by hash, that found has; by comparing those with all rows."""
    rows = _clean(vectors, id_col, vector_col)
    d = length_of(rows)
    if d is None:
        return 1.0
    rows = rows.filter(F.size("v") == d)
    picked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id")).limit(queries).collect()
    q, names = np.array([r.v for r in picked], float).reshape(len(picked), d), np.array([r.vec_id for r in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(q):
                ids, s = batch.column(0).to_numpy(), q @ matrix(batch.column(1)).T
                s[names[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(s, top, 1)
                i, j = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(ids[top[i, j]]), pa.array(best[i, j])], ["query_id", "vec_id", "score"])

    true = _ranked(rows.mapInArrow(run, FOUND), k)
    both = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count("*")).first()
    return both[0] / both[1] if both[1] else 1.0
