"""Removal of repeated passages with a count-min prefilter (operator 8).

A window is ``SPAN`` words in a row. Every window has a key: the least hash of
its ``GRAM``-word grams, so equal windows have equal keys and neighbours mostly
share one; a document counts each of its keys once.

1. The count-min sketch has two rows of cells. Its width follows the number of keys, so
   it is kept in slices of at most ``SLICE_BITS`` bits of cells; a hash puts both cells
   of a key into one slice. Every block of a partition's keys gives a partial sketch of
   the slices that it touches; the partial sketches of a slice are added up, one slice
   at a time in an array of fixed size, and the merged slice keeps one bit a cell: two or
   more. The blocks then meet the merged slices. The estimate of a key, the least of its
   cells, is at least the number of documents with the window; a narrower sketch lets more
   windows through to the exact step, it never loses one.
2. Windows whose key is estimated at two or more are grouped exactly by a 128-bit
   hash of their words; one that also starts in a document of smaller doc_id
   removes its words. A task first compares the windows it has itself: those with
   a smaller document at hand are decided there, so of a window that a third of
   the documents share each task sends on its smallest document only.

Documents with the same words take part once, by their smallest doc_id; the
others lose every word if they have a window at all.

Defined results: null and wordless texts have no words and keep none; a text of
fewer than ``SPAN`` words keeps all; rows that share a doc_id are judged each by
itself and never remove words from one another; a null doc_id is neither smaller
nor larger than another, so such rows keep all; repeated rows stay; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeris.llm.common import scratch_table, table

SPAN = 50
GRAM = 8
CELLS_PER_KEY = 4
# Cells of a slice: at least 2^20 (fewer if the sketch is smaller), and as many as keep the
# number of slices at 4096, up to 2^26 (two byte arrays of 64 MB in the task that merges).
SLICE_BITS = (20, 26)
# Keys of a block.
BLOCK_KEYS = 1 << 20
# Tasks that share the blocks of a slice, which a key of very many documents makes large.
SALTS = 4
# Windows that a task compares at a time.
CHUNK = 1 << 20
# An odd base: it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
NOTHING = hashlib.sha256(b"").hexdigest()

SUMMARY_SCHEMA = "doc_id long, h1 long, h2 long, n_words long, sha string, keys array<long>"
BLOCK_SCHEMA = "slice int, salt int, keys binary, docs binary"
PARTIAL_SCHEMA = "slice int, row int, cells binary, counts binary"
MERGED_SCHEMA = "slice int, often binary"
WINDOW_SCHEMA = "w1 long, w2 long, doc_id long, h1 long, start int, decided boolean"

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, for n exponents."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def _bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of the words of a text joined by one space."""
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    return np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(joined)]])


def window_keys(joined: bytes, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """The key of every window of a text of at least ``span`` words."""
    octets = np.frombuffer(joined, dtype=np.uint8)
    up, down = _powers(len(octets) + 1)
    sums = np.zeros(len(octets) + 1, dtype=np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[:len(octets)], out=sums[1:])
    first, last = _bounds(joined)
    first, last = first[:len(first) - gram + 1], last[gram - 1:]
    grams = (sums[last] - sums[first]) * down[first]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    # minimum of span - gram + 1 in a row: doubling, then two that overlap
    width, reach = span - gram + 1, 1
    least = grams
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def _joined(text: bytes | None) -> tuple[bytes, int]:
    words = text.split() if text else []  # bytes: ASCII white space only
    return b" ".join(words), len(words)


def _halves(digest: int) -> tuple[int, int]:
    low, high = digest & (1 << 64) - 1, digest >> 64
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def _summaries(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                out: list[list] = [[] for _ in range(5)]
                for text in part.column(1).to_pylist():
                    joined, n = _joined(text)
                    keys = (np.unique(window_keys(joined, span, gram)).view(np.int64)
                            if n >= span else np.zeros(0, dtype=np.int64))
                    row = (*_halves(xxhash.xxh3_128_intdigest(joined)), n,
                           hashlib.sha256(joined).hexdigest(), keys)
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                    ["doc_id", "h1", "h2", "n_words", "sha", "keys"])
    return run


def _decide(parts: list[tuple]) -> pa.RecordBatch:
    """Windows of a chunk, marked where a smaller document of the chunk has the same."""
    w1, w2, doc, h1, start = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((doc, w2, w1))
    w1, w2, doc, h1, start = w1[order], w2[order], doc[order], h1[order], start[order]
    new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    decided = doc > least
    return pa.RecordBatch.from_arrays(
        [pa.array(w1, mask=decided), pa.array(w2, mask=decided), pa.array(doc), pa.array(h1),
         pa.array(start), pa.array(decided)], ["w1", "w2", "doc_id", "h1", "start", "decided"])


def _windows(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, parts, held = xxhash.xxh3_128_digest, [], 0
        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                joined, n = _joined(text)
                if n < span:
                    continue
                keys = window_keys(joined, span, gram).view(np.int64)
                at = np.flatnonzero(np.isin(keys, np.asarray(wanted, dtype=np.int64)))
                if not len(at):
                    continue
                first, last = _bounds(joined)
                blob = b"".join([digest(joined[a:b]) for a, b in
                                 zip(first[at].tolist(), last[at + span - 1].tolist())])
                hashes = np.frombuffer(blob, dtype="<i8").reshape(-1, 2)
                h1 = _halves(xxhash.xxh3_128_intdigest(joined))[0]
                parts.append((hashes[:, 0], hashes[:, 1], np.full(len(at), doc),
                              np.full(len(at), h1), at.astype(np.int32)))
                held += len(at)
                if held >= CHUNK:
                    yield _decide(parts)
                    parts, held = [], 0
        if parts:
            yield _decide(parts)
    return run


def kept_words(joined: bytes, starts: list[int], span: int = SPAN) -> tuple[int, bytes]:
    """(words removed, kept words joined) after the windows at ``starts`` go."""
    first, last = _bounds(joined)
    edges = np.zeros(len(first) + 1, dtype=np.int64)
    at = np.unique(np.asarray(starts, dtype=np.int64))
    edges[at] += 1
    np.subtract.at(edges, at + span, 1)
    gone = np.cumsum(edges[:-1]) > 0
    kept = b" ".join([joined[a:b] for a, b in zip(first[~gone].tolist(), last[~gone].tolist())])
    return int(gone.sum()), kept


def _removals(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc, text, h1, starts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                joined, n = _joined(text)
                if n < span or _halves(xxhash.xxh3_128_intdigest(joined))[0] != h1:
                    continue  # another row with this doc_id
                removed, kept = kept_words(joined, starts, span)
                for column, value in zip(out, (doc, h1, removed, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["doc_id", "h1", "n_removed", "kept_sha"])
    return run


def sketch_size(n_keys: int, cells_per_key: int = CELLS_PER_KEY) -> tuple[int, int]:
    """(bits of a slice's number, bits of a cell's number in its slice)."""
    width = max(16, int(n_keys * cells_per_key).bit_length())
    low, high = SLICE_BITS
    inner = min(width, max(low, min(high, width - 12)))
    return width - inner, inner


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(keys: np.ndarray, outer: int, inner: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(slice, cells in the two rows) of each key."""
    first = _mixed(keys.view(np.uint64) + np.uint64(BASE))
    second = _mixed(first + np.uint64(BASE))
    mask = np.uint64((1 << inner) - 1)
    part = second >> np.uint64(64 - outer) if outer else np.zeros(len(keys), dtype=np.uint64)
    return part.astype(np.int32), ((first & mask).astype(np.uint32), (second & mask).astype(np.uint32))


def _key_blocks(outer: int, inner: int):
    """(slice, keys, documents) of blocks of keys."""
    def rows(keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        part = places(keys, outer, inner)[0]
        order = np.argsort(part, kind="stable")
        numbers, first = np.unique(part[order], return_index=True)
        ends = [*first[1:].tolist(), len(keys)]
        cut = [order[a:b] for a, b in zip(first.tolist(), ends)]
        salts = pa.array([int(docs[at[0]]) % SALTS for at in cut], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), salts, *[pa.array([x[at].astype("<i8").tobytes() for at in cut], pa.binary())
                                                     for x in (keys, docs)]],
            ["slice", "salt", "keys", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys = part.column(1).flatten().to_numpy()
                lengths = part.column(1).value_lengths().to_numpy()
                held.append((keys, np.repeat(part.column(0).to_numpy(), lengths)))
                n += len(keys)
                if n >= BLOCK_KEYS:
                    yield rows(*(np.concatenate([h[i] for h in held]) for i in range(2)))
                    held, n = [], 0
        if n:
            yield rows(*(np.concatenate([h[i] for h in held]) for i in range(2)))
    return run


def _partial_sketches(outer: int, inner: int):
    """The touched cells of a block's own sketch; a count over 255 counts as 255."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[list] = [[], [], [], []]
                for row, cells in enumerate(places(np.frombuffer(keys, "<i8"), outer, inner)[1]):
                    cells, counts = np.unique(cells, return_counts=True)
                    for column, value in zip(out, (number, row, cells.astype("<u4").tobytes(),
                                                   np.minimum(counts, 255).astype(np.uint8).tobytes())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    ["slice", "row", "cells", "counts"])
    return run


def _merged_sketches(inner: int):
    """Adds up partial sketches that come slice by slice; one bit a cell remains."""
    def row(number: int, sketch: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([np.packbits(sketch >= 2, axis=1).tobytes()], pa.binary())],
            ["slice", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sketch = None, np.zeros((2, 1 << inner), dtype=np.uint8)
        for batch in batches:
            for i in range(batch.num_rows):
                number, which = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if number != now:
                    if now is not None:
                        yield row(now, sketch)
                    now = number
                    sketch[:] = 0
                cells = np.frombuffer(batch.column(2)[i].as_buffer(), "<u4")
                counts = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)
                added = sketch[which, cells].astype(np.uint16) + counts
                sketch[which, cells] = np.minimum(added, 255)
        if now is not None:
            yield row(now, sketch)
    return run


def _often(outer: int, inner: int):
    """(document, key) of the keys whose cells both hold two or more. A merged slice comes
    before the blocks that it decides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(2)[i].is_valid:
                    bits = np.frombuffer(batch.column(2)[i].as_py(), np.uint8).reshape(2, -1)
                    continue
                keys, docs = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in range(2))
                kept = np.ones(len(keys), dtype=bool)
                for row, cells in enumerate(places(keys, outer, inner)[1]):
                    kept &= (bits[row, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(docs[kept]), pa.array(keys[kept])], ["first_id", "key"])
    return run


def repeated_keys(sources: DataFrame, cells_per_key: int = CELLS_PER_KEY) -> DataFrame:
    """(first_id, keys) with the keys of each document that a count-min sketch over
    all documents estimates at two or more."""
    total = sources.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).collect()[0]["n"]
    outer, inner = sketch_size(total, cells_per_key)
    # made twice from the written sources, which costs less than a copy of all keys
    blocks = sources.select("first_id", "keys").mapInArrow(_key_blocks(outer, inner), BLOCK_SCHEMA)
    partial = blocks.select("slice", "keys").mapInArrow(_partial_sketches(outer, inner), PARTIAL_SCHEMA)
    merged = partial.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        _merged_sketches(inner), MERGED_SCHEMA)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    merged = scratch_table(merged, "sketch").select("slice", salts.alias("salt"), F.lit(None).cast("binary").alias("keys"),
                                                    F.lit(None).cast("binary").alias("docs"), "often")
    together = blocks.withColumn("often", F.lit(None).cast("binary")).unionByName(merged)
    together = together.repartition("slice", "salt").sortWithinPartitions("slice", "salt", F.col("keys").isNotNull())
    often = together.select("keys", "docs", "often").mapInArrow(_often(outer, inner), "first_id long, key long")
    return often.groupBy("first_id").agg(F.collect_set("key").alias("keys"))


def deduplicated(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text"))
    summary = scratch_table(rows.mapInArrow(_summaries(span, gram), SUMMARY_SCHEMA), "summaries")
    sources = (summary.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= span)).groupBy("h1", "h2")
               .agg(F.min("doc_id").alias("first_id"), F.min_by("keys", "doc_id").alias("keys")))
    sources = scratch_table(sources, "sources")
    wanted = scratch_table(repeated_keys(sources), "repeated-keys")
    texts = scratch_table(rows.join(wanted, F.col("doc_id") == F.col("first_id"))
                              .select("doc_id", "text", "keys"), "repeated-texts")
    windows = scratch_table(texts.mapInArrow(_windows(span, gram), WINDOW_SCHEMA), "windows")
    same = Window.partitionBy("w1", "w2")
    late = (windows.where("not decided").withColumn("least", F.min("doc_id").over(same))
                   .where("doc_id > least"))
    gone = windows.where("decided").select("doc_id", "h1", "start").unionAll(
        late.select("doc_id", "h1", "start"))
    gone = scratch_table(gone.groupBy("doc_id", "h1").agg(F.collect_list("start").alias("starts")), "gone")
    cut = texts.select("doc_id", "text").join(gone, "doc_id").select("doc_id", "text", "h1", "starts")
    cut = cut.mapInArrow(_removals(span), "doc_id long, h1 long, n_removed long, kept_sha string")
    cut = scratch_table(cut.dropDuplicates(["doc_id", "h1"]), "cut")
    out = (summary.select("doc_id", "h1", "h2", "n_words", "sha")
                  .join(sources.select("h1", "h2", "first_id"), ["h1", "h2"], "left")
                  .join(cut, ["doc_id", "h1"], "left"))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))


def op8_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT n, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT n, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT n, unnest(range(s, s + 50)) AS p
  FROM win JOIN first USING (h) WHERE win.doc_id > m),
words AS (SELECT n, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT n, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS k
  FROM words ANTI JOIN gone USING (n, p) GROUP BY n)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (n)
"""
