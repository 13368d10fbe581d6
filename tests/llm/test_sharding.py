"""Sharding (operator 3) against a plain minimax partition."""

import hashlib
import zlib

from aeris.llm import sharding
from tests.llm import frames


def plain(rows, shards):
    sizes = {}
    for _, text in rows:
        data = (text or "").encode()
        atom = int(hashlib.md5(data).hexdigest()[:4], 16)
        sizes[atom] = sizes.get(atom, 0) + len(data) + 1
    order = sorted(sizes)

    def fill(capacity, enough):
        out, shard, load = {}, 0, 0
        for a in order:
            if load + sizes[a] > capacity or load >= enough:
                shard, load = shard + 1, 0
            out[a], load = shard, load + sizes[a]
        return out
    capacity = max(sizes.values(), default=0)
    while max(fill(capacity, capacity + 1).values(), default=0) >= shards:
        capacity += 1
    lo, hi = 1, capacity + 1
    while lo < hi:
        middle = (lo + hi) // 2
        if max(fill(capacity, middle).values(), default=0) < shards:
            hi = middle
        else:
            lo = middle + 1
    return fill(capacity, hi)


def check(spark, rows, shards):
    got = sharding.sharded(frames.documents(spark, rows), shards).collect()
    where = plain(rows, shards)
    wanted = sorted((repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()),
                     where[int(hashlib.md5((t or "").encode()).hexdigest()[:4], 16)]) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"], r["shard"]) for r in got) == wanted
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_edges(spark):
    check(spark, frames.edge_rows(), 4)


def test_hot_text_and_many_texts(spark):
    rows = [(i, "the same text") for i in range(300)] + [(1000 + i, f"text {i} " * (1 + i % 9)) for i in range(600)]
    check(spark, rows, 16)


def test_a_hot_text_leaves_no_shard_empty(spark):
    rows = [(i, "the same text " * 20) for i in range(700)] + [(1000 + i, f"text {i} " * 15) for i in range(3000)]
    got = sharding.sharded(frames.documents(spark, rows), 16).collect()
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert min(loads) > 0 and max(loads) < 1.1 * 700 * 281
    rest = sorted(loads)[:-1]
    assert rest[-1] < 1.2 * rest[1]  # one shard may end at the hot text


def test_fewer_texts_than_shards_and_none(spark):
    check(spark, [(1, "a"), (2, "b")], 16)
    assert sharding.sharded(frames.empty(spark)).count() == 0
