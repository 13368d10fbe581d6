"""Shared passages by winnowing.

The fingerprint of a word sequence is the set of least k-gram hashes over all
windows of w consecutive k-grams. Two sequences that share a span of k + w - 1
words share every window inside it and so its least hash: the span is always
found. Everything is column arithmetic; a text stays in its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeris.llm.common import let


def kgram_hashes(words: Column, k: int) -> Column:
    """One hash for each k words in a row (``words`` evaluated once)."""
    return let(words, lambda w: F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(0), F.size(w) - k),
        lambda i: F.xxhash64(F.lit(k), *[w[i + j] if j else w[i] for j in range(k)])))
        .otherwise(F.array().cast("array<bigint>")))


def window_minima(hashes: Column, width: int) -> Column:
    """The least hash of every ``width`` in a row, without repeats; a shorter
    list has none."""
    if width == 1:
        return F.array_distinct(hashes)
    return let(hashes, lambda h: F.when(F.size(h) >= width, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(h) - width),
        lambda i: F.least(*[h[i + j] if j else h[i] for j in range(width)]))))
        .otherwise(F.array().cast("array<bigint>")))


def split_span(span: int, gram: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = span and k at most ``gram``."""
    k = min(gram, span)
    return k, span - k + 1


def winnowed(words: Column, span: int, gram: int) -> Column:
    """Fingerprint that finds every shared span of ``span`` words."""
    k, width = split_span(span, gram)
    return window_minima(kgram_hashes(words, k), width)
