"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 2).

Every vector is divided by its norm and turned by one fixed random rotation;
its code is the signs, one bit a dimension. Two scalars correct the code: the
norm, and the cosine between the code's unit vector and the turned vector. For
a query q the inner product is estimated as norm * <code, turned q> / cosine,
and the error is at most

    norm * |q| * sqrt(1 - cosine^2) / cosine * EPSILON / sqrt(dimension - 1)

but for a small probability that EPSILON sets. The codes move packed; a block of them
is unpacked where it meets a block of queries, and one matrix product gives the estimates.

A query's bar is its exact k-th best score in a sample of the vectors (``SAMPLE`` rows
of least id hash, fewer beyond ``SAMPLE_BYTES``, the same for all queries). The k nearest
reach it, so of every block only the vectors whose estimate plus error does are looked at.
Where these are many, their scores first come from a product in single precision, and only
what reaches the query's k-th best so far, less the rounding, is computed exactly. The
sample sets the cost alone: a low bar means more scores, never other results.

Vectors and queries move in blocks, dealt over the tiles of a grid: a tile holds one lane of
vectors and one lane of queries, is one group of a cogroup and yields at most k rows a query.
A vector is copied to as many tiles as there are query lanes and the other way round, so the
numbers of lanes are the least that keep a tile within ``VECTOR_TILE`` and ``QUERY_TILE``
bytes and every core at work. Nothing of them passes through the driver. No index is
fitted: the rotation depends on the dimension alone.

Defined results: rows with a null id take no part, nor do vectors that are
null, zero, or hold null or non-finite components, nor those of another
dimension than most have (the smaller of two dimensions in a tie). Rows that
share a vec_id count as one, with the smallest vector. Ties go to the smaller
vec_id. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from aeris.llm.common import scratch_table, table

NEAREST = 20
QUERY_EVERY = 20
EPSILON = 2.5
VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
VECTOR_TILE = 64 << 20
QUERY_TILE = 128 << 20
STRIP = 1024  # vectors whose products with a block of queries are looked at together
DENSE = 16  # a product of whole blocks costs less than single scores of more than 1 in so many pairs
PAIR_BYTES = 16 << 20
SAMPLE = 4096
SAMPLE_BYTES = 8 << 20
SEED = 20240521

VECTOR_SCHEMA = "lane int, ids binary, bits binary, norms binary, cosines binary, vectors binary"
QUERY_SCHEMA = "lane int, query_ids binary, queries binary, bars binary"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


@lru_cache(maxsize=1)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, norms, cosines) of the rows of ``vectors``."""
    dim = vectors.shape[1]
    wide = vectors.astype(np.float64)
    scale = np.abs(wide).max(axis=1, keepdims=True)
    norms = lengths(wide)
    turned = (wide / scale) @ rotation(dim) / (norms / scale[:, 0])[:, None]
    cosines = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return np.packbits(turned > 0, axis=1), norms, cosines


def lengths(wide: np.ndarray) -> np.ndarray:
    """Norms of the rows; tiny and huge ones stay finite."""
    scale = np.abs(wide).max(axis=1, keepdims=True)
    return np.sqrt(((wide / scale) ** 2).sum(axis=1)) * scale[:, 0]


def turned(queries: np.ndarray) -> np.ndarray:
    dim = queries.shape[1]
    return ((queries.astype(np.float64) @ rotation(dim)) / np.sqrt(dim)).astype(np.float32)


def signs(bits, sizes, dim: int) -> np.ndarray:
    """Packed codes as rows of single numbers of the given ``sizes``."""
    return (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) * sizes.astype(np.float32)[:, None]


def estimates(bits, norms, cosines, queries) -> np.ndarray:
    """Estimated inner products of packed codes (rows) with queries (columns)."""
    return signs(bits, norms / cosines, queries.shape[1]) @ turned(queries).T


def bars(ids, vectors, query_ids, queries, k: int) -> np.ndarray:
    """Each query's k-th best score among ``vectors``, itself left out, less what rounding
    may take; minus infinity if there are fewer."""
    if len(ids) <= k:
        return np.full(len(query_ids), -np.inf)
    doubles, wide = vectors.astype(np.float64), queries.astype(np.float64)
    scores = wide @ doubles.T
    scores[query_ids[:, None] == ids] = -np.inf
    found = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    reach = np.sqrt((wide ** 2).sum(axis=1)) * np.sqrt((doubles ** 2).sum(axis=1).max())
    found = found - 1e-9 * reach
    return np.where(np.isfinite(found), found, -np.inf)


class Vectors:
    """A block of vectors. All numbers but ``doubles`` are shares of its largest norm, so that none overflows."""

    def __init__(self, ids, bits, norms, cosines, vectors, epsilon: float):
        dim = vectors.shape[1]
        self.ids, self.doubles, self.largest = ids, vectors.astype(np.float64), norms.max()
        self.singles = (self.doubles / self.largest).astype(np.float32)
        share = norms / self.largest
        self.codes = signs(bits, share / cosines, dim)
        spread = share * np.sqrt(np.maximum(0, 1 - cosines ** 2)) / cosines * epsilon / np.sqrt(max(1, dim - 1))
        self.spread = spread.astype(np.float32)[:, None]


class Nearest:
    """The k best of a block of queries among the vector blocks that it has met."""

    def __init__(self, query_ids, queries, lowest, k: int):
        self.ids, self.wide, self.lowest, self.k = query_ids, queries.astype(np.float64), lowest, k
        self.lengths = lengths(self.wide)
        unit = self.wide / self.lengths[:, None]
        self.unit, self.turned = unit.astype(np.float32), turned(unit)
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query row, vec_id, score
        self.bar = np.full(len(query_ids), -np.inf)  # the k-th best score so far

    def _add(self, query, vec_id, score) -> None:
        query, vec_id, score = (np.concatenate(x) for x in zip(self.best, (query, vec_id, score), strict=True))
        order = np.lexsort((vec_id, -score, query))
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        kept = np.arange(len(query)) - first[query] < self.k
        self.best = query[kept], vec_id[order][kept], score[order][kept]
        last = first + self.k - 1  # the k-th best, of those that have so many
        full = np.flatnonzero(last < np.append(first[1:], len(query)))
        worst = score[order][last[full]]
        # a score that overflowed is no bar
        self.bar[full] = np.where(np.isfinite(worst), worst, -np.inf)

    def meet(self, block: Vectors) -> None:
        """Vectors whose estimates cannot reach a query's bar ``lowest`` are left out; the k best of the
        others are kept, below ``lowest`` too."""
        dim = self.wide.shape[1]
        rounding = 1.2e-7 * (dim + 8)
        low = (self.lowest / self.lengths / block.largest - 1e-5).astype(np.float32)
        bar = (self.bar / self.lengths / block.largest - rounding).astype(np.float32)
        pairs = []
        for lo in range(0, len(block.ids), STRIP):
            part = slice(lo, lo + STRIP)
            found = block.codes[part] @ self.turned.T
            found += block.spread[part]
            # a number that overflowed is no reason to leave a vector out
            reach = ~(found < low)
            if np.count_nonzero(reach) * DENSE > reach.size:
                found = block.singles[part] @ self.unit.T
                new = np.flatnonzero(np.isneginf(bar))
                if len(new) and len(found) > self.k:
                    # the k-th best here bounds them as well; one more, as a query may meet itself
                    some = np.where(reach, found, np.float32(-np.inf))[:, new]
                    bar[new] = np.partition(some, -self.k - 1, axis=0)[-self.k - 1] - 2 * rounding
                reach &= ~(found < bar)
            pairs.append(np.flatnonzero(reach) + lo * len(self.ids))
        pairs, step = np.concatenate(pairs), max(1, PAIR_BYTES // (8 * dim))
        for lo in range(0, len(pairs), step):
            vector, query = np.divmod(pairs[lo:lo + step], len(self.ids))
            other = block.ids[vector] != self.ids[query]
            vector, query = vector[other], query[other]
            scores = (block.doubles[vector] * self.wide[query]).sum(axis=1)
            high = ~(scores < self.bar[query])
            if high.any():
                self._add(query[high], block.ids[vector[high]], scores[high])


def _blocks(rows: Iterator[pa.RecordBatch], size: int):
    """(ids, vectors) of up to ``size`` rows."""
    ids, vectors = [], []
    for batch in rows:
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            ids.append(part.column(0).to_numpy())
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            vectors.append(flat.reshape(part.num_rows, -1))
            if sum(map(len, ids)) >= size:
                yield np.concatenate(ids), np.concatenate(vectors)
                ids, vectors = [], []
    if ids:
        yield np.concatenate(ids), np.concatenate(vectors)


def _lane(block: int, lanes: int) -> int:
    """The lane of a task's block: neighbours in turn, from a start that differs by task."""
    return (int(TaskContext.get().partitionId() * 0.6180339887498949 % 1 * lanes) + block) % lanes


def _vector_blocks(lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (ids, vectors) in enumerate(_blocks(batches, VECTOR_BLOCK)):
            bits, norms, cosines = encode(vectors)
            row = [ids.astype("<i8").tobytes(), bits.tobytes(), norms.astype("<f8").tobytes(),
                   cosines.astype("<f8").tobytes(), vectors.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_lane(block, lanes)], pa.int32()), *[pa.array([x], pa.binary()) for x in row]],
                ["lane", "ids", "bits", "norms", "cosines", "vectors"])
    return run


def _query_blocks(ids: np.ndarray, vectors: np.ndarray, k: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (query_ids, queries) in enumerate(_blocks(batches, QUERY_BLOCK)):
            lowest = bars(ids, vectors, query_ids, queries, k)
            row = [query_ids.astype("<i8").tobytes(), queries.tobytes(), lowest.astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_lane(block, lanes)], pa.int32()), *[pa.array([x], pa.binary()) for x in row]],
                ["lane", "query_ids", "queries", "bars"])
    return run


def _joined(blocks: pa.Table, kinds: dict, size: int) -> Iterator[list[np.ndarray]]:
    """The columns of the blocks, small ones put together until there are ``size`` ids."""
    rows = []
    for row in range(blocks.num_rows):
        rows.append([np.frombuffer(blocks.column(name)[row].as_buffer(), kind) for name, kind in kinds.items()])
        if sum(len(x[0]) for x in rows) >= size or row == blocks.num_rows - 1:
            yield [np.concatenate(x) for x in zip(*rows, strict=True)]
            rows = []


def _search(dim: int, dtype: str, k: int, epsilon: float):
    vector_kinds = {"ids": "<i8", "bits": np.uint8, "norms": "<f8", "cosines": "<f8", "vectors": dtype}
    query_kinds = {"query_ids": "<i8", "queries": dtype, "bars": "<f8"}

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        queries = [Nearest(ids, vectors.reshape(-1, dim), lowest, k)
                   for ids, vectors, lowest in _joined(asked, query_kinds, QUERY_BLOCK)]
        for ids, bits, norms, cosines, vectors in _joined(blocks, vector_kinds, VECTOR_BLOCK):
            block = Vectors(ids, bits.reshape(len(ids), -1), norms, cosines, vectors.reshape(-1, dim), epsilon)
            for some in queries:
                some.meet(block)
        found = [(some.ids[some.best[0]], *some.best[1:]) for some in queries]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.chunked_array([pa.array(x[c], kind) for x in found], kind)
                         for c, kind in enumerate(kinds)], ["query_id", "vec_id", "score"])
    return run


def lanes(vectors: int, queries: int, dim: int, width: int, k: int, cores: int) -> tuple[int, int]:
    """(vector lanes, query lanes) of the grid: two tiles a core at the least, copied as little as can be."""
    one, asked = dim * (width + 1 / 8) + 24, dim * width + 16 + 24 * k  # bytes, a query's with its results
    tiles, most = 2 * cores, (-(-vectors // VECTOR_BLOCK) or 1, -(-queries // QUERY_BLOCK) or 1)
    even = round((tiles * queries * asked / (vectors * one)) ** 0.5) if vectors else 1
    down = min(most[1], max(1, even, -(-queries * (asked + 24 * k) // QUERY_TILE)))
    across = min(most[0], max(-(-tiles // int(down)), -(-vectors * one // VECTOR_TILE)))
    return int(across), int(down)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one per vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    rows = scratch_table(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    common = (rows.groupBy(F.size("embedding").alias("dim")).count()
                  .orderBy(F.desc("count"), "dim").limit(1))
    return rows.where(F.size("embedding") == common.select("dim").scalar())


def _sample(rows: DataFrame, dim: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of ``size`` rows by least hash of the id, at most SAMPLE_BYTES."""
    size = min(size, max(1, SAMPLE_BYTES // (8 * dim)))
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    ids = found.column(0).to_numpy()
    flat = found.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), dim)


def nearest(vectors: DataFrame, k: int = NEAREST, query_every: int = QUERY_EVERY,
            epsilon: float = EPSILON, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product of every
    row whose vec_id is divisible by ``query_every``, among all other rows."""
    rows = usable(vectors)
    query = F.col("vec_id") % query_every == 0
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(query).alias("asked"),
                    F.max(F.size("embedding")).alias("dim")).collect()[0]
    dim = size["dim"] or 1
    dtype = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across, down = lanes(size["n"], size["asked"], dim, int(dtype[-1]), k, cores)

    def dealt(blocks: DataFrame, tile: Column, copies: int) -> DataFrame:
        each = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        # more partitions than tiles: few of them get two
        return (each.withColumn("tile", tile).drop("lane", "other")
                    .repartition(4 * across * down, "tile").groupBy("tile"))

    blocks = rows.mapInArrow(_vector_blocks(across), VECTOR_SCHEMA)
    asked = rows.where(query).mapInArrow(_query_blocks(*_sample(rows, dim, sample), k, down), QUERY_SCHEMA)
    found = dealt(blocks, F.col("lane") * down + F.col("other"), down).cogroup(
        dealt(asked, F.col("other") * down + F.col("lane"), across)).applyInArrow(
        _search(dim, dtype, k, epsilon), FOUND_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


def op2_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
