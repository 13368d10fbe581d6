"""Hard negatives (operator 12) against brute force in Python's integers."""

import math
import random

import numpy as np
import pytest

from aeris.llm import negatives
from tests.llm import frames


def brute(rows, every=100, k=5, kn=5, least=80, most=100):
    whole = {i: (label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows}
    out = []
    for a, (own, va) in whole.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == own][:k]:
            found = [i for i in order if whole[i][0] != own and least * score[p] <= 100 * score[i] <= most * score[p]]
            out += [(a, p, rank + 1, i, score[p], score[i]) for rank, i in enumerate(found[:kn])]
    return sorted(out)


def mined(df, label="label", **options):
    from pyspark.sql import functions as F
    rows = negatives.usable(df, F.col(label))
    return sorted(tuple(r) for r in negatives.mine(rows, **options).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_random_vectors_and_edge_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=11)], int(rng.integers(3))) for i in range(300)]
    good += [(300 + i, good[40][1], i % 3) for i in range(40)]  # a vector that many rows share
    bad = [(400, None, 1), (500, [1.0] * 11, None), (600, [None] + [1.0] * 10, 1), (700, [float("nan")] * 11, 1),
           (800, [float("inf")] + [1.0] * 10, 2), (900, [1.0] * 4, 1), (1000, [], 1), (None, [1.0] * 11, 1)]
    df = spark.createDataFrame(good + bad + good[:3], SCHEMA).selectExpr(
        "*", "1 as rank", "2 as score", "3 as lane", "4 as target", "5 as anchor_id", "6 as row", "7 as vector")
    wanted = brute([(i, label, v) for i, v, label in good], every=10)
    assert wanted and mined(df, anchor_every=10) == wanted


def test_every_range_and_sign(spark):
    rng = random.Random(2)
    for low, high in ((-3, -1), (0, 0), (-70000, 70000), (1, 2)):
        rows = [(i, [float(rng.randint(low, high)) for _ in range(8)], rng.randrange(2)) for i in range(80)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert mined(df, anchor_every=20) == brute([(i, label, v) for i, v, label in rows], every=20)


def test_components_beyond_64_bits_are_exact():
    rng = random.Random(4)
    planes = negatives.planes_of(2.0 ** 40, -2.0 ** 40)
    a = [[rng.randint(-2 ** 40, 2 ** 40) for _ in range(5)] for _ in range(3)]
    c = [[rng.randint(-2 ** 40, 2 ** 40) for _ in range(5)] for _ in range(7)]
    assert negatives.score_type(planes, 5) is object
    tables = negatives.subset_sums(np.array(a, dtype=object), object)
    got = negatives.scores(tables, negatives.bit_planes(np.array(c), planes))
    top = negatives.LONGEST
    assert got.tolist() == [[max(-top, min(top, sum(x * y for x, y in zip(v, w)))) for w in a] for v in c]


def test_subset_sums_and_planes():
    anchors = np.arange(20).reshape(2, 10) - 7
    tables = negatives.subset_sums(anchors, np.int32)
    assert tables.shape == (2, 256, 2)
    for byte in (0, 1, 0b10000001, 255):
        picked = [d for d in range(8) if byte >> d & 1]
        assert tables[0, byte].tolist() == anchors[:, picked].sum(axis=1).tolist()
    assert negatives.planes_of(0, 0) == 1 and negatives.planes_of(0, -1) == 1
    assert negatives.planes_of(127, -128) == 8 and negatives.planes_of(128, 0) == 9


def test_extremes(spark):
    assert mined(frames.smoke(spark, "embeddings").limit(0)) == []
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], SCHEMA)
    assert mined(alone) == []
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1), (2, [1e300], 2)],
                                 "vec_id long, embedding array<double>, label int")
    assert mined(huge) == [(0, 1, 1, 2, negatives.LONGEST, negatives.LONGEST)]


@pytest.mark.parametrize("steps", [7, 4096])
def test_block_sizes_change_nothing(steps):
    rng = np.random.default_rng(0)
    anchors, rows = rng.integers(-100, 100, (5, 13)), rng.integers(-128, 128, (200, 13))
    tables = negatives.subset_sums(anchors, np.int64)
    got = np.concatenate([negatives.scores(tables, negatives.bit_planes(rows[lo:lo + steps], 8))
                          for lo in range(0, 200, steps)])
    assert (got == rows @ anchors.T).all()
