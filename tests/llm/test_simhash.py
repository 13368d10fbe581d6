"""SimHash near-duplicates (operator 1) against a brute-force version."""

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from aeris.llm import components, simhash
from tests.llm import frames


def plain_fingerprint(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", folded) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42)
              for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, prints[i], least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def near_copies(rng, n, size):
    base = frames.sentence(rng, size).split()
    out = []
    for _ in range(n):
        words = list(base)
        words[rng.randrange(size)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    clean = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(clean.encode()) == plain_fingerprint(clean)


def test_components_on_edges_and_near_copies(spark):
    rng = random.Random(1)
    rows = frames.edge_rows()
    rows += [(100 + i, t) for i, t in enumerate(near_copies(rng, 40, 300))]
    rows += [(200 + i, t) for i, t in enumerate(near_copies(rng, 30, 900))]
    got = simhash.simhash_components(frames.documents(spark, rows)).collect()
    found = sorted((repr(r["doc_id"]), r["fp"] % (1 << 64), repr(r["component_id"])) for r in got)
    wanted = sorted((repr(d), f, repr(c)) for d, f, c in plain_components(rows))
    assert found == wanted
    assert len({c for _, _, c in wanted}) < len({f for _, f, _ in wanted})  # near copies did link


def test_one_document_of_each_component_stays(spark):
    rng = random.Random(2)
    rows = frames.edge_rows() + [(100 + i, t) for i, t in enumerate(near_copies(rng, 25, 900))]
    kept = simhash.near_duplicates_removed(frames.documents(spark, rows))
    assert kept.columns == frames.documents(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    wanted = {c for _, _, c in plain_components(rows)}
    assert sorted(ids, key=repr) == sorted(wanted, key=repr)


def test_empty(spark):
    assert simhash.simhash_components(frames.empty(spark)).count() == 0
    assert simhash.near_duplicates_removed(frames.empty(spark)).count() == 0


def test_covering_meets_every_close_pair():
    """Of two fingerprints within two bits the one with the smaller home meets the other there."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= 1 << int(bit)
        row, anchor, home = simhash.anchors_of(np.array([a, b], dtype=np.uint64), 2)
        first, second = anchor[home]
        small, other = (first, 1) if first <= second else (second, 0)
        assert small in anchor[row == other]


def test_every_block_has_one_code_word_within_three_bits():
    patterns, first = simhash.error_table(2)
    assert len(patterns[0]) == 2048 and (np.diff(first[0]) == 1).all()
    assert sum(map(len, patterns)) == 2048 + 8855 + 33649


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)] + [(5, 5), (2000, 2001), (2001, 2000), (2000, 2001)]
    links = spark.createDataFrame(chain + star, "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1301)}) == 1
    assert len(set(got.values())) == 3 and len(got) == 301 + 301 + 2
