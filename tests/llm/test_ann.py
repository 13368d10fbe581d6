"""Nearest neighbours (operator 2) against brute force."""

import numpy as np
import pytest

from aeris.llm import ann
from tests.llm import frames


def brute(rows, k, every):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores_on_the_table(spark):
    table = frames.smoke(spark, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    wanted, got = brute(rows, 20, 20), collected(ann.nearest(table))
    assert got.keys() == wanted.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits / (20 * len(wanted)) >= 0.95
    exact = {q: dict(v) for q, v in wanted.items()}
    for q, found in got.items():
        for i, score in found:
            if i in exact[q]:
                assert score == pytest.approx(exact[q][i], abs=1e-12)


def test_edge_rows_take_no_part(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    bad = [(100, None), (120, [0.0] * 8), (140, [None] + [1.0] * 7), (160, [float("nan")] * 8),
           (180, [float("inf")] + [1.0] * 7), (200, [1.0] * 5), (None, [1.0] * 8)]
    twice = [good[7], good[20]]
    df = spark.createDataFrame(good + bad + twice, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 as rank", "2 as score", "3 as lane")
    assert collected(ann.nearest(df, k=5)) == {
        q: [(i, pytest.approx(s, abs=1e-12)) for i, s in v] for q, v in brute(good, 5, 20).items()}


def test_ties_and_fewer_candidates_than_asked(spark):
    same = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame(same, "vec_id long, embedding array<float>")
    got = collected(ann.nearest(df, k=5))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[20]] == [0, 1, 2, 3, 4]
    few = collected(ann.nearest(df.where("vec_id < 4"), k=5))
    assert [i for i, _ in few[0]] == [1, 2, 3]
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 70])
def test_estimates_from_packed_bytes(dim):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(2000, dim)).astype(np.float32)
    bits, norms, cosines = ann.encode(vectors)
    queries = rng.normal(size=(5, dim))
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(float) * 2 - 1) / np.sqrt(dim)
    plain = (norms / cosines)[:, None] * (signs @ (queries @ ann.rotation(dim)).T)
    np.testing.assert_allclose(ann.estimates(bits, norms, cosines, queries), plain, rtol=1e-4, atol=1e-4)


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(2000, 64)).astype(np.float32)
    bits, norms, cosines = ann.encode(vectors)
    queries = rng.normal(size=(5, 64))
    spread = norms * np.sqrt(1 - cosines ** 2) / cosines * ann.EPSILON / np.sqrt(63)
    error = np.abs(ann.estimates(bits, norms, cosines, queries) - vectors @ queries.T)
    assert (error <= spread[:, None] * np.linalg.norm(queries, axis=1)).mean() > 0.98


def test_the_sample_sets_the_cost_and_not_the_result(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * (1 + i % 7)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wanted = brute(rows, 10, 20)
    for size in (5, 100, 900):
        got = collected(ann.nearest(df, k=10, sample=size, epsilon=8.0))  # a bound that no error exceeds
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}


def test_a_bar_that_overflows_leaves_nothing_out():
    huge = np.full((30, 4), 1e200)
    ids = np.arange(30)
    assert (ann.bars(ids, huge, ids[:2], huge[:2], 5) == -np.inf).all()
    assert (ann.bars(ids[:3], huge[:3], ids[:2], huge[:2], 5) == -np.inf).all()


def test_no_block_passes_through_the_driver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = ann.nearest(df, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CoGroup" in plan


@pytest.mark.parametrize("across, down", [(1, 1), (3, 1), (1, 3), (4, 2)])
def test_the_grid_does_not_change_the_result(spark, monkeypatch, across, down):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "lanes", lambda *_: (across, down))
    # a bound that no error exceeds
    assert collected(ann.nearest(df, k=7, epsilon=8.0)) == {
        q: [(i, pytest.approx(s, abs=1e-12)) for i, s in v] for q, v in brute(rows, 7, 20).items()}


def test_tiles_fit_and_every_core_has_some():
    for vectors, queries, dim in [(0, 0, 1), (500, 25, 64), (50_000, 2_500, 64), (3_000_000, 150_000, 64),
                                  (20_000_000, 1_000_000, 64), (1_000_000, 1_000_000, 768)]:
        across, down = ann.lanes(vectors, queries, dim, 4, 20, 6)
        assert across * down >= min(12, -(-vectors // ann.VECTOR_BLOCK)) and across > 0 and down > 0
        assert vectors / across * dim * 4 <= ann.VECTOR_TILE or vectors / across <= ann.VECTOR_BLOCK
        assert queries / down * dim * 4 <= ann.QUERY_TILE or queries / down <= ann.QUERY_BLOCK
    assert ann.lanes(50_000, 2_500, 64, 4, 20, 6)[1] == 1  # what is few is not dealt out


@pytest.mark.parametrize("size, pairs", [(1, 1 << 20), (10, 64), (200, 1 << 20)])
def test_blocks_met_one_by_one(monkeypatch, size, pairs):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 12)).astype(np.float32) * (1 + np.arange(200) % 5)[:, None]
    vectors[50:120] = vectors[50]  # ties go to the smaller id
    ids = rng.permutation(200)
    monkeypatch.setattr(ann, "PAIR_BYTES", pairs)
    block = ann.Nearest(ids[:60], vectors[:60], np.full(60, -np.inf), 6)
    for lo in range(0, 200, size):
        part = slice(lo, lo + size)
        block.meet(ann.Vectors(ids[part], *ann.encode(vectors[part]), vectors[part], 8.0))
    wanted = brute(list(zip(ids.tolist(), vectors.tolist(), strict=True)), 6, 1)
    query, found, scores = block.best
    for j in range(60):
        assert found[query == j].tolist() == [i for i, _ in wanted[int(ids[j])]]
        np.testing.assert_allclose(scores[query == j], [s for _, s in wanted[int(ids[j])]], atol=1e-12)


@pytest.mark.parametrize("size, dense", [(30, 16), (600, 16), (600, 1)])
def test_a_neighbour_that_the_codes_miss_leaves_its_place_to_the_next(monkeypatch, size, dense):
    monkeypatch.setattr(ann, "DENSE", dense)
    monkeypatch.setattr(ann, "STRIP", 100)
    vectors = np.random.default_rng(7).normal(size=(600, 16)).astype(np.float32)
    ids, exact = np.arange(600), vectors.astype(np.float64) @ vectors[:40].T.astype(np.float64)
    lowest = ann.bars(ids, vectors, ids[:40], vectors[:40], 5)  # the k-th best scores themselves
    block = ann.Nearest(ids[:40], vectors[:40], lowest, 5)
    for lo in range(0, 600, size):
        part = slice(lo, lo + size)
        block.meet(ann.Vectors(ids[part], *ann.encode(vectors[part]), vectors[part], 0.3))
    bits, norms, cosines = ann.encode(vectors)
    spread = norms * np.sqrt(1 - cosines ** 2) / cosines * 0.3 / np.sqrt(15)
    most = ann.estimates(bits, norms, cosines, vectors[:40]) + spread[:, None] * np.linalg.norm(vectors[:40], axis=1)
    missed = 0
    for j in range(40):
        left = [i for i in np.argsort(-exact[:, j]) if i != j and most[i, j] >= lowest[j]]
        assert block.best[1][block.best[0] == j].tolist() == left[:5]
        missed += exact[left[:5], j].min() < lowest[j]
    assert missed


@pytest.mark.parametrize("scale", [1e-30, 1e120])
def test_tiny_and_huge_vectors_are_found(scale):
    vectors = np.random.default_rng(6).normal(size=(300, 8)) * scale
    ids = np.arange(300)
    block = ann.Nearest(ids[:20], vectors[:20], ann.bars(ids[:100], vectors[:100], ids[:20], vectors[:20], 5), 5)
    block.meet(ann.Vectors(ids, *ann.encode(vectors), vectors, 8.0))
    wanted = brute(list(zip(ids.tolist(), vectors.tolist(), strict=True)), 5, 1)
    for j in range(20):
        assert block.best[1][block.best[0] == j].tolist() == [i for i, _ in wanted[j]]
