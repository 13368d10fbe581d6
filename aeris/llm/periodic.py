"""Runs of periodic words by block convolution (operator 13).

A run is a stretch of words with smallest period q, at least ``POWER`` * q and
``LEAST`` words long, that no neighbour extends. The texts of a batch are laid
out as one row of word codes, with a code of its own between two texts.

At scale B = 2, 4, 8, ... the row is cut into blocks of B words. A run of period
q, (2B - 1) / 3 <= q < (4B - 1) / 3, holds a whole block followed by its copy q
words on, since the first block in it starts fewer than B words from its start
and B - 1 + q + B <= 4q. The sum of squared differences between a block and each
B words of the window that follows is computed by convolution, modulo a prime,
with a number-theoretic transform of exact integers; a sum of zero is an
occurrence, its distance a seed. (Scales up to ``DIRECT`` are convolved term by
term, which costs less there.) Every seed is extended word by word in both
directions, which also settles sums that are zero only modulo the prime.

Two kinds of block need no transform: one with a word that does not come again
within the scale's distances, and one whose window lies in a known run of a
period up to B (its copies are that run's).

Defined results: null and blank texts have no words, no runs and an empty
collapsed text; repeated rows stay; null ids are kept; an empty table gives no
rows; further columns are ignored. A text is never split: the longest one sets
the memory of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import let, table

POWER = 4
LEAST = 6
# Words that are searched together (one text may have more).
BATCH_WORDS = 1 << 18
# Scales up to this are convolved term by term.
DIRECT = 8
# Numbers in one stack of transforms.
STACK = 1 << 19
# A prime with roots of unity of order 2^27, and a generator.
PRIME, GENERATOR = 2013265921, 31
# Fixed value: what separates words.
BLANKS = r"[\x20\x09-\x0D]+"

FOUND_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_ROOTS: dict[tuple[int, bool], list[np.ndarray]] = {}


def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for the halves of size, size / 2, ..., 2."""
    if (size, inverse) not in _ROOTS:
        levels, n = [], size
        while n > 1:
            root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
            root = pow(root, PRIME - 2, PRIME) if inverse else root
            powers = np.ones(n // 2, dtype=np.uint64)
            filled = 1
            while filled < n // 2:  # doubling: powers [0, k) give [k, 2k)
                step = np.uint64(pow(root, filled, PRIME))
                powers[filled:2 * filled] = powers[:filled] * step % PRIME
                filled *= 2
            levels.append(powers)
            n //= 2
        _ROOTS[size, inverse] = levels
    return _ROOTS[size, inverse]


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order."""
    rows, size = x.shape
    x = x.copy()
    n = size
    for powers in _roots(size, False):
        part = x.reshape(rows, size // n, 2, n // 2)
        low, high = part[:, :, 0], part[:, :, 1]
        total, gap = (low + high) % PRIME, (low + (PRIME - high)) * powers % PRIME
        part[:, :, 0], part[:, :, 1] = total, gap
        n //= 2
    return x


def inverse(x: np.ndarray) -> np.ndarray:
    """The rows that ``transform`` takes to ``x``."""
    rows, size = x.shape
    x = x.copy()
    n = 2
    for powers in reversed(_roots(size, True)):
        part = x.reshape(rows, size // n, 2, n // 2)
        low, high = part[:, :, 0].copy(), part[:, :, 1] * powers % PRIME
        part[:, :, 0], part[:, :, 1] = (low + high) % PRIME, (low + (PRIME - high)) % PRIME
        n *= 2
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % PRIME


def squared_differences(blocks: np.ndarray, windows: np.ndarray, direct: bool) -> np.ndarray:
    """(block, shift): sum of squared differences, modulo the prime, between a block
    and the part of its window that starts at a shift. Windows hold at most twice a block."""
    size = blocks.shape[1]
    shifts = windows.shape[1] - size + 1
    if direct:
        out = np.zeros((len(blocks), shifts), dtype=np.uint64)
        for i in range(size):
            gap = windows[:, i:i + shifts] + (PRIME - blocks[:, i:i + 1])
            out += (gap % PRIME) ** 2 % PRIME
        return out % PRIME
    square = np.zeros((len(windows), windows.shape[1] + 1), dtype=np.uint64)
    np.cumsum(windows * windows % PRIME, axis=1, out=square[:, 1:])  # below 2^31 * length
    of_window = (square[:, size:] - square[:, :shifts]) % PRIME
    of_block = (blocks * blocks % PRIME).sum(axis=1) % PRIME
    # correlation: a cyclic convolution with the block turned round; the wrapped part is not read
    padded = np.zeros((2, len(blocks), 2 * size), dtype=np.uint64)
    padded[0, :, :windows.shape[1]] = windows
    padded[1, :, -size + 1:] = blocks[:, :0:-1]
    padded[1, :, 0] = blocks[:, 0]
    both = transform(padded.reshape(2 * len(blocks), 2 * size))
    product = inverse(both[:len(blocks)] * both[len(blocks):] % PRIME)[:, :shifts]
    return (of_window + of_block[:, None] + (PRIME - product) * np.uint64(2)) % PRIME


def _next_distance(codes: np.ndarray) -> np.ndarray:
    """Words to the next occurrence of the same code; the row's length if there is none."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), len(codes), dtype=np.int64)
    same = codes[order[:-1]] == codes[order[1:]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _matched(codes: np.ndarray, at: int, step: int, bound: int, distance: int) -> int:
    """How far from ``at`` (in direction ``step``) words equal those ``distance`` on, up to ``bound``."""
    done, size = 0, 64
    while True:
        lo, hi = (at + done, min(at + done + size, bound)) if step > 0 else (max(at - done - size, bound), at - done)
        if lo >= hi:
            return done
        unlike = np.flatnonzero(codes[lo:hi] != codes[lo + distance:hi + distance])
        if len(unlike):
            return done + (int(unlike[0]) if step > 0 else hi - lo - 1 - int(unlike[-1]))
        done += hi - lo
        size *= 2


class _Known:
    """Runs found so far, and how far from each word the known runs reach."""

    def __init__(self, n: int):
        self.runs: set[tuple[int, int, int]] = set()
        self.reach = np.zeros(n, dtype=np.int64)
        self.later: list[tuple[int, int]] = []

    def add(self, start: int, end: int, period: int, scale: int) -> None:
        if (start, end, period) not in self.runs:
            self.runs.add((start, end, period))
            if period <= scale:
                np.maximum(self.reach[start:end], end, out=self.reach[start:end])
            else:  # may not yet stand for its blocks: they are shorter than its period
                self.later.append((start, end))

    def next_scale(self) -> None:
        for start, end in self.later:
            np.maximum(self.reach[start:end], end, out=self.reach[start:end])
        self.later = []


def find_runs(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ``codes``: small
    non-negative integers; ``longest``: words that a run can have at most."""
    n = len(codes)
    known, scale = _Known(n), 2
    farthest = _next_distance(codes)
    # blocks beyond the end, and windows too, meet codes that nothing equals
    top = int(codes.max(initial=0)) + 1
    while True:
        lo, hi = -(-(2 * scale - 1) // 3), -(-(4 * scale - 1) // 3) - 1
        if POWER * lo > longest:
            return sorted((s, e - s, p) for s, e, p in known.runs)
        blocks = n // scale
        nearest = farthest[:blocks * scale].reshape(blocks, scale).max(axis=1)
        starts = np.flatnonzero(nearest <= hi) * scale
        starts = starts[known.reach[starts] < starts + scale + hi]
        width = hi - lo + scale
        for part in range(0, len(starts), max(1, STACK // (2 * scale))):
            some = starts[part:part + max(1, STACK // (2 * scale))]
            where = some[:, None] + lo + np.arange(width)
            beyond = where >= n
            windows = codes[np.where(beyond, 0, where)].astype(np.uint64)
            windows[beyond] = (top + where[beyond]).astype(np.uint64)
            chosen = codes[some[:, None] + np.arange(scale)].astype(np.uint64)
            zero = squared_differences(chosen, windows, scale <= DIRECT) == 0
            which, shift = np.nonzero(zero)
            _extend(codes, known, some[which], shift + lo, scale)
        known.next_scale()
        scale *= 2


def _extend(codes: np.ndarray, known: _Known, places: np.ndarray, distances: np.ndarray, scale: int) -> None:
    """Runs from seeds (block start, distance), smaller distances first."""
    n = len(codes)
    order = np.lexsort((places, distances))
    # of one distance: the stretch that the last seed has covered
    distance, covered = -1, 0
    for at, d in zip(places[order].tolist(), distances[order].tolist()):
        if d != distance:
            distance, covered = d, 0
        if at + scale <= covered or known.reach[at] >= at + d + scale:
            continue
        right = _matched(codes, at, 1, n - d, d)
        if right < scale:
            continue  # zero modulo the prime only
        left = _matched(codes, at, -1, 0, d)
        covered = at + right
        start, end = at - left, at + right + d
        if end - start >= max(LEAST, POWER * d):
            known.add(start, end, d, scale)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc_ids: list = []
    texts: list[list[bytes]] = []

    def block() -> pa.RecordBatch:
        coded: dict[bytes, int] = {}
        lengths = np.asarray([len(w) for w in texts], dtype=np.int64)
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        codes = np.empty(int(ends[-1]), dtype=np.int64)
        for lo, words in zip(starts.tolist(), texts):
            codes[lo:lo + len(words)] = [coded.setdefault(w, len(coded)) for w in words]
        codes[ends - 1] = len(coded) + np.arange(len(texts))  # a code of its own behind each text
        found: dict[int, list] = {}
        for start, length, period in find_runs(codes, int(lengths.max())):
            k = int(np.searchsorted(ends, start, side="right"))
            found.setdefault(k, []).append((start - int(starts[k]), length, period))
        collapsed = []
        for k, words in enumerate(texts):
            if k in found:
                kept = np.ones(len(words), dtype=bool)
                for start, length, period in found[k]:
                    kept[start + period:start + length] = False
                words = [w for w, keep in zip(words, kept.tolist()) if keep]
            collapsed.append(b" ".join(words).decode("utf-8", "replace"))
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in found.get(k, ())] for k in range(len(texts))]
        out = pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(lengths),
             pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
             pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
        doc_ids.clear(), texts.clear()
        return out
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids.append(doc_id)
            texts.append(text.as_py().split() if text.is_valid else [])
            size += len(texts[-1]) + 1
            if size >= BATCH_WORDS:
                yield block()
                size = 0
    if texts:
        yield block()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start, then
    period, and its words without those that a run repeats, joined by one space."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text")).mapInArrow(_search, FOUND_SCHEMA)


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The query's own noise: in a tenth of the documents (by hash of the id) the words
    from a certain one on repeat with a certain period."""
    draw = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(draw / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (F.lit(3) + g % 8)).cast("long") + 1
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, F.when(i < a, i).otherwise(
            a + (i - a) % p).cast("int"))), " ")).otherwise(text)
    words = F.array_remove(F.split(text, BLANKS), "")
    return F.when(draw % 10 == 0, let(words, repeated)).otherwise(text)


def op13_block_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)

    def better(best: Column, run: Column) -> Column:
        # runs come by start, then period: only a truly greater quotient wins
        greater = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | greater, run).otherwise(best)
    kind = found.schema["runs"].dataType.elementType
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                       F.aggregate("runs", F.lit(None).cast(kind), better).alias("best"),
                       F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
