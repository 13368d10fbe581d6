"""Periodic runs (operator 13) against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from aeris.llm import periodic
from aeris.llm.queries import QUERIES
from tests.conftest import SMOKE_DIR
from tests.llm import frames


def brute(words):
    """Runs by comparing the words with themselves at every distance."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.add((start, length, q))
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def codes_of(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)


@pytest.mark.parametrize("direct", [1, 8])
def test_random_words_and_planted_runs(monkeypatch, direct):
    monkeypatch.setattr(periodic, "DIRECT", direct)  # 1: transforms at every scale
    rng = random.Random(direct)
    for _ in range(250):
        words = []
        while len(words) < rng.choice([8, 40, 160]):
            base = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 30))]
            n = rng.randrange(1, 7 * len(base))
            words += (base * 8)[:n]
            words += [rng.randrange(100, 140) for _ in range(rng.randrange(3))]
        assert periodic.find_runs(codes_of(words), len(words)) == brute(words)


def test_words_that_are_all_one_and_nested_runs():
    assert periodic.find_runs(np.zeros(5000, dtype=np.int64), 5000) == [(0, 5000, 1)]
    inner = [0] * 8 + [1]
    assert periodic.find_runs(codes_of(inner * 5), 45) == brute(inner * 5)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    for words in (fib[-1], fib[-1] * 4, (fib[6] * 5 + [7]) * 6):
        assert periodic.find_runs(codes_of(words), len(words)) == brute(words)


def test_long_periods():
    rng = random.Random(9)
    base = [rng.randrange(10_000) for _ in range(700)]
    words = [rng.randrange(10_000) for _ in range(333)] + base * 4 + base[:100] + [5] * 20
    found = periodic.find_runs(codes_of(words), len(words))
    assert (333, 2900, 700) in found or any(q == 700 and n >= 2900 for _, n, q in found)
    assert any(q == 1 and n >= 20 for _, n, q in found)


def test_transform_is_a_cyclic_convolution():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, periodic.PRIME, (2, 3, 16)).astype(np.uint64)
    got = periodic.inverse(periodic.transform(a) * periodic.transform(b) % periodic.PRIME)
    for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
        assert z == [sum(x[i] * y[(k - i) % 16] for i in range(16)) % periodic.PRIME for k in range(16)]
    assert (periodic.inverse(periodic.transform(a)) == a).all()


@pytest.mark.parametrize("size", [2, 8, 64])
def test_squared_differences(size):
    rng = np.random.default_rng(size)
    blocks, windows = rng.integers(0, 30_000, (4, size)), rng.integers(0, 30_000, (4, 2 * size))
    windows[1, 1:size + 1] = blocks[1]
    wanted = [[sum((int(b) - int(w)) ** 2 for b, w in zip(blocks[r], windows[r, d:d + size])) % periodic.PRIME
               for d in range(size + 1)] for r in range(4)]
    for direct in (False, True):
        got = periodic.squared_differences(blocks.astype(np.uint64), windows.astype(np.uint64), direct)
        assert got.tolist() == wanted


def test_edge_texts(spark):
    rows = frames.edge_rows() + [(300, "a b " * 40), (301, "x " * 6), (302, "x " * 5), (303, "1 2 3\t1\n2 3 1 2 3 1 2 3"),
                                 (304, "é É " * 30 + " "), (None, "q " * 9)]
    got = periodic.periodic_runs(frames.documents(spark, rows)).collect()
    wanted = []
    for i, text in rows:
        words = (text or "").encode().split()
        runs = brute(words) if len(words) < 2000 or len(set(words)) < 10 and len(words) < 3500 else None
        wanted.append((i, len(words), runs, None if runs is None else collapsed([w.decode() for w in words], runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    plain = [w for w in wanted if w[2] is not None]
    assert len(got) == len(rows)
    for w in plain:
        assert w in got, w[:2]
    assert sorted((g[0], g[1]) for g in got if g[0]) == sorted((w[0], w[1]) for w in wanted if w[0])
    assert periodic.periodic_runs(frames.empty(spark)).collect() == []


def test_small_batches_change_nothing(monkeypatch):
    import pyarrow as pa
    rng = random.Random(0)
    texts = [" ".join(["p q r"] * rng.randrange(1, 9) + [f"w{rng.randrange(5)}" for _ in range(rng.randrange(20))]).encode()
             for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    one = [r for out in periodic._search(iter([batch])) for r in out.to_pylist()]
    monkeypatch.setattr(periodic, "BATCH_WORDS", 10)
    assert [r for out in periodic._search(iter([batch])) for r in out.to_pylist()] == one
    assert any(r["runs"] for r in one)


def test_query_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in frames.smoke(spark).collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_block_convolution"](spark, SMOKE_DIR).collect()}
    assert got.keys() == docs.keys()
    planted = 0
    for i, text in docs.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        if n > 1500:
            continue  # brute force takes too long
        runs = brute(words)
        r = got[i]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(
            collapsed([w.decode() for w in words], runs).encode()).hexdigest()
        if runs:
            s, k, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, k, q, 1000 * k // q)
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
    assert planted >= 5
