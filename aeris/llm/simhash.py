"""SimHash near-duplicates by anchor-point covering (operator 1).

Fingerprints. Words are maximal runs without ASCII white space after the A-Z
fold; every shingle of three words (repeats count) votes with its XXH64, and a
bit is set where more than half of the shingles have it set.

Anchors. The first 46 bits are two blocks of 23, each covered by the perfect
binary Golay code: every block lies within 3 bits of exactly one code word. The
pair of code words is a fingerprint's home anchor. If two fingerprints differ
in at most d bits, d1 of them in the first block and d2 in the second, then
each lies within (3 + d1, 3 + d2) bits of the other's home. A fingerprint is
therefore copied to every anchor within (3 + d1, 3 + d2) bits for some
d1 + d2 <= d, and compared at each anchor with the fingerprints at home there.
Of the two homes of a pair the smaller one is enough, so only smaller anchors
receive copies.

Only distinct fingerprints take part: copies of a text, however many, are one
row. A fingerprint has at most 64 + 2016 others within two bits, so links grow
with the number of distinct fingerprints, never with the square of a group.

Defined results: null and blank texts have fingerprint zero and link like any
other; texts of one or two words have that one shingle; an empty table gives no
rows; repeated rows stay and share a component; a null doc_id is kept but never
names a component unless all ids of it are null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import scratch_table, table
from aeris.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCK = 23
BLOCK_MASK = (1 << BLOCK) - 1
# Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b101011100011


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as an unsigned number."""
    import xxhash

    words = text.lower().split() if text else []  # bytes: ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.asarray([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        starts = [0]
        for n in map(len, words):
            starts.append(starts[-1] + n + 1)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b - 1], SEED)
                              for a, b in zip(starts, starts[shingle:])),
                             dtype=np.uint64, count=len(words) - shingle + 1)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    seen = np.bincount((octets + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
    votes = seen @ _octet_bits()  # 8 octets x 8 bits, least significant first
    bits = (2 * votes > len(hashes)).astype(np.uint8).ravel()
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


@lru_cache(maxsize=1)
def _octet_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1,
                         bitorder="little").astype(np.int64)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            prints = np.asarray(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator (11 bits)."""
    rest = values.astype(np.int64).copy()
    for bit in range(BLOCK - 1, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    return rest


@lru_cache(maxsize=2)
def error_table(max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per excess e = 0..max_bits: the error patterns of weight 3 + e (all up to
    3 for e = 0) sorted by syndrome, and the first index of each syndrome."""
    from itertools import combinations

    patterns, first = [], []
    for excess in range(max_bits + 1):
        weights = range(4) if excess == 0 else [3 + excess]
        found = np.asarray([sum(1 << b for b in bits) for w in weights
                            for bits in combinations(range(BLOCK), w)], dtype=np.int64)
        rests = _syndromes(found)
        order = np.argsort(rests, kind="stable")
        patterns.append(found[order])
        first.append(np.searchsorted(rests[order], np.arange(2049)))
    return patterns, first


def _near(block: np.ndarray, excess: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) for all code words at 3 + ``excess`` bits (up to 3 for 0)."""
    patterns, first = error_table(max_bits)
    rest = _syndromes(block)
    lo, hi = first[excess][rest], first[excess][rest + 1]
    counts = hi - lo
    rows = np.repeat(np.arange(len(block)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows, block[rows] ^ patterns[excess][np.repeat(lo, counts) + within]


def anchors_of(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of unsigned fingerprints: the home anchor of each and
    every smaller anchor that may be home to one within ``max_bits``."""
    low = (prints & np.uint64(BLOCK_MASK)).astype(np.int64)
    high = (prints >> np.uint64(BLOCK) & np.uint64(BLOCK_MASK)).astype(np.int64)
    homes = _near(low, 0, max_bits)[1] | _near(high, 0, max_bits)[1] << BLOCK
    rows, keys = [np.arange(len(prints))], [homes]
    for one in range(max_bits + 1):
        row1, word1 = _near(low, one, max_bits)
        for two in range(max_bits + 1 - one):
            if one == two == 0:
                continue
            # both lists are ordered by row: pair every code word of the first
            # block with every one of the second of the same row
            row2, word2 = _near(high, two, max_bits)
            start = np.searchsorted(row2, np.arange(len(prints) + 1))
            counts = (start[1:] - start[:-1])[row1]
            pick = np.repeat(np.arange(len(row1)), counts)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            key = word1[pick] | word2[start[row1[pick]] + within] << BLOCK
            row = row1[pick]
            keep = key < homes[row]
            rows.append(row[keep])
            keys.append(key[keep])
    row = np.concatenate(rows)
    home = np.zeros(len(row), dtype=bool)
    home[:len(prints)] = True
    return row, np.concatenate(keys), home


def _anchors(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                prints = batch.column(0).slice(lo, 2048).to_numpy(zero_copy_only=False)
                row, anchor, home = anchors_of(prints.view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(prints[row]), pa.array(home)],
                    ["anchor", "fp", "home"])
    return run


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): the pairs of distinct fingerprints (column fp) that differ in at
    most ``max_bits`` bits; a pair with one home anchor appears once."""
    placed = prints.select("fp").mapInArrow(_anchors(max_bits), "anchor long, fp long, home boolean")
    home = placed.where("home").select("anchor", F.col("fp").alias("u"))
    guest = placed.select("anchor", F.col("fp").alias("v"), F.col("home").alias("both"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    once = ~F.col("both") | (F.col("u") < F.col("v"))
    return home.join(guest, "anchor").where(close & once).select("u", "v")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, root, component_id) of every document; root names the
    component by one of its fingerprints."""
    prints = scratch_table(fingerprints(docs, shingle), "simhash")
    return prints.join(named_components(prints, max_bits), "fp").select(
        "doc_id", "fp", "root", "component_id")


def named_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of (doc_id, fp)."""
    nodes = scratch_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = connected_components(near_links(nodes, max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = scratch_table(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return scratch_table(rooted.join(least, "root").select("fp", "root", "component_id"),
                         "simhash-named")


def near_duplicates_removed(docs: DataFrame, shingle: int = SHINGLE,
                            max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each component: a row whose doc_id names it.

    A doc_id that stands in several rows, or is null, does not tell rows apart:
    these rows (few or none) are matched by fingerprint instead, and of those
    that qualify in a component one stays."""
    prints = scratch_table(fingerprints(docs, shingle), "simhash")
    named = named_components(prints, max_bits)
    found = prints.join(named, "fp")
    repeated = scratch_table(prints.groupBy("doc_id").agg(F.count("*").alias("n"))
                             .where("n > 1 or doc_id is null").select("doc_id"), "repeated-ids")
    losers = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    dropped = scratch_table(losers.unionByName(repeated).distinct(), "dropped-ids")
    sole = docs.where("doc_id is not null").join(
        dropped.withColumnRenamed("doc_id", "_dropped"),
        F.col("doc_id").cast("long") == F.col("_dropped"), "left_anti")

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        values = [fingerprint(t, shingle) for t in texts]
        return pd.Series(np.asarray(values, dtype=np.uint64).view(np.int64))

    again = docs.join(repeated.withColumnRenamed("doc_id", "_again"),
                      F.col("doc_id").cast("long").eqNullSafe(F.col("_again")), "left_semi")
    again = (again.withColumn("_fp", print_of(F.col("text").cast("binary")))
                  .join(named.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"),
                                     F.col("component_id").alias("_component")), "_fp")
                  .where(F.col("doc_id").cast("long").eqNullSafe(F.col("_component")))
                  .dropDuplicates(["_root"]))
    return sole.unionByName(again.select(*docs.columns))


def op1_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
