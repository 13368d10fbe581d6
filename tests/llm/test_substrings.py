"""Repeated passages (operator 8) against a plain search."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from aeris.llm import substrings
from tests.llm import frames


def words_of(text):
    return (text or "").encode().split()


def plain(rows, span=50):
    least = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - span + 1):
            if doc is not None:
                key = tuple(w[i:i + span])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - span + 1):
            if doc is not None and least[tuple(w[i:i + span])] < doc:
                gone.update(range(i, i + span))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((repr(doc), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, chunk=None, monkeypatch=None):
    got = substrings.deduplicated(frames.documents(spark, rows)).collect()
    found = sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert found == plain(rows)
    return found


def test_edges_passages_and_copies(spark):
    rng = random.Random(0)
    rows = frames.edge_rows()
    passages = [frames.sentence(rng, n) for n in (49, 50, 51, 80, 300)]
    for k in range(60):
        p = passages[k % 5]
        rows.append((500 + k, f"{frames.sentence(rng, rng.randrange(40))}\n{p}\t {frames.sentence(rng, rng.randrange(60))}"))
    base = frames.sentence(rng, 200).split()
    for k in range(30):  # near copies
        w = list(base)
        w[rng.randrange(200)] = f"n{k}"
        rows.append((700 + k, " ".join(w)))
    rows += [(800 + k, passages[3]) for k in range(20)] + [(900, passages[4] + " " + passages[4])]
    rows += [(901, "same " * 400), (902, "same " * 300), (903, "other " * 120)]
    found = check(spark, rows)
    assert sum(r[2] > 0 for r in found) > 80


def test_order_of_ids_not_of_rows(spark):
    rng = random.Random(1)
    text = frames.sentence(rng, 70)
    check(spark, [(9, text + " a"), (3, "b " + text), (-4, text + " c"), (None, text + " d"), (9, text + " e")])


def test_empty(spark):
    assert substrings.deduplicated(frames.empty(spark)).count() == 0


@given(st.lists(st.sampled_from([b"a", b"bb", b"c", b"\xc3\xa9"]), min_size=50, max_size=160))
@settings(max_examples=60, deadline=None)
def test_keys_are_functions_of_the_window(words):
    keys = substrings.window_keys(b" ".join(words))
    assert len(keys) == len(words) - 49
    for i in (0, len(keys) // 2, len(keys) - 1):
        assert substrings.window_keys(b" ".join(words[i:i + 50]))[0] == keys[i]


def test_sketch_never_underestimates(spark):
    """However narrow the sketch, every key of two documents is kept."""
    rng = np.random.default_rng(0)
    keys = [[int(x) for x in rng.integers(0, 60, 20)] for _ in range(30)]
    df = spark.createDataFrame([(i, sorted(set(k))) for i, k in enumerate(keys)], "first_id long, keys array<long>")
    got = {(r["first_id"], k) for r in substrings.repeated_keys(df, 1).collect() for k in r["keys"]}
    count = {}
    for k in keys:
        for x in set(k):
            count[x] = count.get(x, 0) + 1
    assert got >= {(i, x) for i, k in enumerate(keys) for x in k if count[x] > 1}


def test_kept_words():
    assert substrings.kept_words(b"a b c d e f", [1, 2, 2], 2) == (3, b"a e f")
    assert substrings.kept_words(b"a b", [0], 2) == (2, b"")


def _counted(spark, lists, cells_per_key, monkeypatch, block, inner):
    monkeypatch.setattr(substrings, "BLOCK_KEYS", block)
    monkeypatch.setattr(substrings, "SLICE_BITS", inner)
    df = spark.createDataFrame(lists, "first_id long, keys array<long>").repartition(5)
    return {r["first_id"]: set(r["keys"]) for r in substrings.repeated_keys(df, cells_per_key).collect()}


def test_merged_partial_sketches_lose_no_repeated_key(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lists = [(d, [int(k) for k in {7, *rng.integers(-(1 << 62), 1 << 62, 30), *rng.integers(0, 4000, 10)}])
             for d in range(400)]
    count = Counter(k for _, keys in lists for k in keys)
    wanted = {d: {k for k in keys if count[k] >= 2} for d, keys in lists}
    for cells, inner in ((4, (8, 9)), (4, (20, 26)), (0, (20, 26))):  # many slices, one, and far too narrow
        got = _counted(spark, lists, cells, monkeypatch, 1000, inner)
        assert all(wanted[d] <= got.get(d, set()) for d in wanted)
        assert all(got[d] <= set(keys) for d, keys in lists)
        extra = sum(len(got[d] - wanted[d]) for d in wanted)
        assert extra < 0.2 * 400 * 30


def test_places_of_a_key():
    keys = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 100_000)
    for outer, inner in ((0, 16), (4, 20), (12, 26)):
        part, cells = substrings.places(keys, outer, inner)
        assert part.min() >= 0 and part.max() < 1 << outer
        assert all(c.max() < 1 << inner for c in cells) and (cells[0] != cells[1]).mean() > 0.99
        assert np.bincount(part, minlength=1 << outer).max() < 2 * len(keys) / (1 << outer) + 60
    assert substrings.sketch_size(0) == (0, 16) and substrings.sketch_size(1 << 22) == (5, 20)
    assert substrings.sketch_size(1 << 36)[1] == 26
