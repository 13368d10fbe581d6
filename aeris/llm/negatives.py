"""Hard negatives by Four-Russians scoring (operator 12).

Vectors become integers, floor(``SCALE`` * x). A candidate is stored as packed
bit planes: bit b of eight dimensions in a row is one byte, the top plane
counting negative (two's complement). For a block of anchors a table per group
of eight dimensions holds the sum of every subset of the anchors' components
there, 256 entries an anchor. A candidate's byte looks up its group's part of
the inner product for one plane; the planes are put together by shift and add,
top plane first. The scores are exact.

Candidates move in blocks, one lane each; an anchor block is copied to every
lane. Lanes grow with the square root of the table, so that the copies of the
anchors (a fixed share of the rows) stay in proportion to the vectors. Scoring
runs twice: the first pass keeps the best rows of an anchor's own label, the
second the best of other labels below each positive. A pair of blocks yields at
most ``positives`` rows an anchor and ``negatives`` rows a positive.

Defined results: rows with a null id, label or vector, a null or non-finite
component, an empty vector, or another dimension than most rows have (the
smaller of two in a tie) take no part. Rows that share a vec_id count as one:
the least label, then the least vector. Ties go to the smaller vec_id. A
positive without a negative in its range gives no row, nor does an anchor alone
in its label; an empty table gives no rows. Further columns are ignored. Where
components are so large that a score may leave 64 bits, scoring goes on in
unbounded integers, slowly; a score outside a long counts as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from aeris.llm.common import scratch_table, table

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
# A negative scores between these hundredths of its positive.
LEAST_SHARE, MOST_SHARE = 80, 100
# Rows of a block of anchors, and of what is scored in one step against it.
ANCHOR_BLOCK = 64
STEP_ROWS = 4096
# Lanes are the square root of the number of rows, divided by this.
LANE_SHARE = 16
LONGEST = (1 << 63) - 1

BLOCK_SCHEMA = "lane int, ids binary, labels binary, bits binary"
ANCHOR_SCHEMA = "anchor_ids binary, anchor_labels binary, anchor_vectors binary, asked binary, asked_of binary"
FOUND_SCHEMA = "anchor_id long, target long, vec_id long, score long"


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; vector in whole numbers
    as doubles, one row per vec_id; written once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    wide = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    # floor() gives longs, which large doubles leave: these are whole numbers already
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < F.lit(2.0 ** 53), F.floor(x).cast("double")).otherwise(x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (F.size("embedding") > 0))
    rows = rows.select("vec_id", F.struct("label", whole.alias("vector")).alias("row"))
    rows = rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")
    rows = scratch_table(rows, "negatives-rows")
    common = (rows.groupBy(F.size("vector").alias("dim")).count()
                  .orderBy(F.desc("count"), "dim").limit(1))
    return rows.where(F.size("vector") == common.select("dim").scalar())


def planes_of(most: float, least: float) -> int:
    """Bits of a two's complement that holds all whole numbers between the two."""
    return max(int(most), -int(least) - 1, 0).bit_length() + 1


def bit_planes(whole: np.ndarray, planes: int) -> np.ndarray:
    """Packed planes (top first, group of eight dimensions, row), one byte each."""
    n, dim = whole.shape
    groups = -(-dim // 8)
    out = np.empty((planes, groups, n), dtype=np.uint8)
    for k in range(planes):
        bit = ((whole >> (planes - 1 - k)) & 1).astype(np.uint8)
        out[k] = np.packbits(bit, axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """(group, byte, anchor): sums of the anchors' components that a byte picks."""
    m, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((m, groups * 8), dtype=dtype)
    padded[:, :dim] = anchors
    tables = np.zeros((groups, 256, m), dtype=dtype)
    for bit in range(8):  # the subsets with this bit are those without it, plus one component
        size = 1 << bit
        component = padded[:, bit::8].T[:, None, :]
        tables[:, size:2 * size] = tables[:, :size] + component
    return tables


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(row, anchor) inner products: a lookup per byte, planes by shift and add."""
    planes, groups, n = bits.shape
    total = np.zeros((n, tables.shape[2]), dtype=tables.dtype)
    for k in range(planes):
        if k:
            total += total
        for g in range(groups):
            part = tables[g].take(bits[k, g], axis=0)
            if k:
                total += part
            else:
                total -= part  # the sign plane
    return total if total.dtype != object else np.clip(total, -LONGEST, LONGEST).astype(np.int64)


def score_type(planes: int, dim: int):
    """The narrowest type that holds every partial sum."""
    bits = 2 * planes + math.ceil(math.log2(dim + 1))
    return np.int32 if bits < 31 else np.int64 if bits < 63 else object


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _unbounded(whole: np.ndarray) -> np.ndarray:
    out = np.empty(whole.shape, dtype=object)
    out[:] = [[int(x) for x in row] for row in whole]
    return out


def _first(order_ids: np.ndarray, order_scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to smaller ids."""
    if len(order_ids) > 4 * k:
        bar = np.partition(order_scores, len(order_scores) - k)[len(order_scores) - k]
        near = np.flatnonzero(order_scores >= bar)
    else:
        near = np.arange(len(order_ids))
    return near[np.lexsort((order_ids[near], -order_scores[near]))][:k]


def _candidate_blocks(dim: int, planes: int):
    """Blocks of the candidates of a lane."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(lo, STEP_ROWS)
                whole = _vectors(part.column(2), dim)
                bits = bit_planes(whole.astype(np.int64) if planes <= 62 else _unbounded(whole), planes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(3).slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in (
                        part.column(0).to_numpy().astype("<i8"), part.column(1).to_numpy().astype("<i8"), bits)]],
                    ["lane", "ids", "labels", "bits"])
    return run


def _anchor_blocks(dim: int):
    """Blocks of anchors, each with the scores that it asks for (none in pass one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ANCHOR_BLOCK):
                part = batch.slice(lo, ANCHOR_BLOCK)
                asked = part.column(3).to_pylist()
                flat = [x for a in asked for x in a or ()]
                row = (part.column(0).to_numpy().astype("<i8"), part.column(1).to_numpy().astype("<i8"),
                       _vectors(part.column(2), dim).astype("<f8"), np.asarray(flat, dtype="<i8"),
                       np.repeat(np.arange(len(asked), dtype="<i8"), [len(a or ()) for a in asked]))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row],
                                                 ["anchor_ids", "anchor_labels", "anchor_vectors", "asked", "asked_of"])
    return run


def _search(dim: int, planes: int, pick):
    """Rows that ``pick`` keeps of every pair of blocks, scored in full."""
    dtype, groups = score_type(planes, dim), -(-dim // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tables = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                got = {f: batch.column(f)[row].as_buffer() for f in (
                    "ids", "labels", "bits", "anchor_ids", "anchor_labels", "anchor_vectors", "asked", "asked_of")}
                whole = {f: np.frombuffer(got[f], "<i8") for f in got if f not in ("bits", "anchor_vectors")}
                anchors = np.frombuffer(got["anchor_vectors"], "<f8").reshape(-1, dim)
                key = got["anchor_ids"].to_pybytes()
                if key != last:
                    exact = anchors.astype(np.int64) if dtype is not object else _unbounded(anchors)
                    last, tables = key, subset_sums(exact, dtype)
                bits = np.frombuffer(got["bits"], np.uint8).reshape(planes, groups, -1)
                found = list(pick(scores(tables, bits), whole))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([f[c] for f in found]).astype(np.int64)) for c in range(4)],
                        ["anchor_id", "target", "vec_id", "score"])
    return run


def _positive_rows(k: int):
    def pick(total: np.ndarray, got: dict) -> Iterator[tuple]:
        for j, (anchor, label) in enumerate(zip(got["anchor_ids"], got["anchor_labels"])):
            rows = np.flatnonzero((got["labels"] == label) & (got["ids"] != anchor))
            rows = rows[_first(got["ids"][rows], total[rows, j], k)]
            if len(rows):
                yield np.full(len(rows), anchor), np.zeros(len(rows)), got["ids"][rows], total[rows, j]
    return pick


def _negative_rows(k: int, least: int, most: int):
    def pick(total: np.ndarray, got: dict) -> Iterator[tuple]:
        for j in np.unique(got["asked_of"]):
            anchor, own = got["anchor_ids"][j], total[:, j]
            targets = got["asked"][got["asked_of"] == j]
            # exact in Python's integers: the bounds as whole scores
            bounds = [(-(-least * int(t) // 100), most * int(t) // 100) for t in targets]
            lowest, highest = min(b[0] for b in bounds), max(b[1] for b in bounds)
            rows = np.flatnonzero((got["labels"] != got["anchor_labels"][j]) & (own >= lowest) & (own <= highest))
            for target, (low, high) in zip(targets, bounds):
                near = rows[(own[rows] >= low) & (own[rows] <= high)]
                near = near[_first(got["ids"][near], own[near], k)]
                if len(near):
                    yield np.full(len(near), anchor), np.full(len(near), target), got["ids"][near], own[near]
    return pick


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES,
         negatives: int = NEGATIVES, least: int = LEAST_SHARE, most: int = MOST_SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for
    ``rows`` as ``usable`` gives them. Anchors: ids divisible by ``anchor_every``."""
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % anchor_every == 0).alias("anchors"),
                     F.max(F.size("vector")).alias("dim"), F.max(F.array_max("vector")).alias("most"),
                     F.min(F.array_min("vector")).alias("least")).first()
    dim, planes = facts["dim"] or 1, planes_of(facts["most"] or 0, facts["least"] or 0)
    lanes = max(1, math.isqrt(facts["n"]) // LANE_SHARE)
    laned = rows.repartition(lanes).withColumn("lane", F.spark_partition_id())
    blocks = scratch_table(laned.mapInArrow(_candidate_blocks(dim, planes), BLOCK_SCHEMA), "negatives-blocks")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    parts = 1 + facts["anchors"] // (16 * ANCHOR_BLOCK)

    def searched(asking: DataFrame, pick) -> DataFrame:
        asked = scratch_table(asking.repartition(parts).mapInArrow(_anchor_blocks(dim), ANCHOR_SCHEMA), "negatives-anchors")
        asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        return blocks.join(asked, "lane").drop("lane").mapInArrow(_search(dim, planes, pick), FOUND_SCHEMA)
    first = searched(anchors.select("vec_id", "label", "vector", F.array().cast("array<bigint>").alias("asked")),
                     _positive_rows(positives))
    pairs = _ranked(first, ["anchor_id"], positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = scratch_table(pairs, "negatives-pairs")
    asking = pairs.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("asked"))  # at most ``positives``
    asking = anchors.join(asking, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", "asked")
    second = searched(asking, _negative_rows(negatives, least, most))
    kept = _ranked(second, ["anchor_id", "target"], negatives).select(
        F.col("anchor_id").alias("_anchor"), F.col("target").alias("_target"), "rank",
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(kept, (F.col("anchor_id") == F.col("_anchor")) & (F.col("positive_score") == F.col("_target")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                      "positive_score", "negative_score")


def shifted_label() -> Column:
    """The query's noise: the next of ten labels where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(usable(table(spark, sf_dir, "embeddings"), shifted_label()))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
