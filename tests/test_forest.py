"""Forests: both ways to grow them agree, and nested evaluation equals separate fits."""

from dataclasses import replace
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeris.operators import forest

FEATURES, TARGETS = ["a", "b", "c", "d"], ["y", "z"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4))
    x[:, 2] = rng.integers(0, 3, 120)
    x[:, 3] = 1.0  # constant
    rows = [(f"k{i}", *map(float, r), float(r[0] + (r[1] > 0)), float(r[2] - r[0]), i % 3) for i, r in enumerate(x)]
    rows += [("none", None, 1.0, 1.0, 1.0, 1.0, 1.0, 0), ("blank", 1.0, 1.0, 1.0, 1.0, None, 1.0, 1)]
    return spark.createDataFrame(rows, "k string, a double, b double, c double, d double, y double, z double, fold int").cache()


def nodes_of(found):
    return sorted((r["g"], r["node"], r["n"], r["w"], tuple(r["s"]), r["feature"], r["bin"], r["gain"])
                  for r in found.nodes.collect())


@pytest.mark.parametrize("folds", [None, 3])
@pytest.mark.parametrize("leaf,size,drawn", [(1, 2, 10), (4, 9, 2)])
def test_levels_and_tasks_grow_the_same_nodes(table, folds, leaf, size, drawn):
    p = forest.Params(4, 5, drawn, leaf, size, 7, 8)
    one = forest.fit_forest(table, FEATURES, TARGETS, "k", p, folds)
    two = forest.fit_forest(table, FEATURES, TARGETS, "k", p, folds, local_cells=0)
    found = nodes_of(one)
    assert found == nodes_of(two) and len(found) > 15
    assert all(n >= leaf for _, _, n, *_ in found)
    assert all(n >= size for _, _, n, _, _, feature, *_ in found if feature is not None)
    children = {(g, node): n for g, node, n, *_ in found}
    for g, node, n, _, _, feature, *_ in found:
        if feature is not None:
            assert children[g, 2 * node] + children[g, 2 * node + 1] == n
        assert node < 2 ** 5


def test_first_split_is_the_best_of_all(table):
    """The root of a tree that draws all features, against trying every cut."""
    p = forest.Params(1, 3, 10, 1, 2, 3, 8)
    found = forest.fit_forest(table, FEATURES, TARGETS, "k", p)
    rows = forest.binned(table.na.drop(), found.cuts, TARGETS, "k").collect()
    for tree, w in enumerate(forest._draws(3, range(3), [r["k"] for r in rows])):
        best = (0.0, None)
        for f, cut in product(range(4), range(8)):
            sides = [[(x, r["y"]) for x, r in zip(w, rows) if x and (r["b"][f] > cut) == side] for side in (False, True)]
            if all(sides):
                score = sum(sum(x * y[t] for x, y in s) ** 2 / sum(x for x, _ in s) for s in sides for t in range(2))
                best = max(best, (score, (f, cut)), key=lambda b: b[0])
        root = [r for r in found.nodes.collect() if r["g"] == tree and r["node"] == 1][0]
        assert (root["feature"], root["bin"]) == best[1]


def test_prediction_is_the_mean_of_the_leaves(table):
    p = forest.Params(3, 4, 2, 2, 4, 1, 8)
    found = forest.fit_forest(table, FEATURES, TARGETS, "k", p)
    nodes = {(r["g"], r["node"]): r for r in found.nodes.collect()}
    bins = {r["k"]: r["b"] for r in forest.binned(table, found.cuts, TARGETS, "k").collect()}
    got = forest.predict(found, table, ["k"]).collect()
    assert len(got) == 121  # targets may be missing, features may not
    for r in got:
        total = np.zeros(2)
        for g in range(4):
            node = 1
            while nodes[g, node]["feature"] is not None:
                node = 2 * node + (bins[r["k"]][nodes[g, node]["feature"]] > nodes[g, node]["bin"])
            total += np.array(nodes[g, node]["s"]) / nodes[g, node]["w"] / forest.UNITS
        assert [r["pred_y"], r["pred_z"]] == pytest.approx(list(total / 4))


def test_importances_are_shares(table):
    got = forest.importances(forest.fit_forest(table, FEATURES, TARGETS, "k", forest.Params(3, 6, 10, 1, 2, 0, 8))).collect()
    assert sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert {r["feature"] for r in got} == set(FEATURES) and [r for r in got if r["feature"] == "d"][0]["importance"] == 0
    assert [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)


@pytest.mark.parametrize("cells", [0, forest.LOCAL_CELLS])
def test_grid_equals_separate_fits(table, cells):
    grid = {"max_depth": [1, 3], "n_estimators": [2, 4], "max_features": [2, "sqrt", 40], "min_samples_leaf": [1, 5],
            "random_state": [0], "min_samples_split": [2, 20]}
    got = {tuple(r[:6]) + (r["target"],): r["mse"] for r in forest.grid_search(
        table, FEATURES, TARGETS, "k", 3, grid, 8, cells).collect()}
    assert len(got) == 2 * 2 * 3 * 2 * 2 * 2
    for depth, trees, drawn, leaf, size in [(1, 2, 2, 1, 2), (3, 4, "sqrt", 5, 20), (3, 2, 40, 1, 20)]:
        p = forest.Params(depth, trees, drawn, leaf, size, 0, 8)
        found = forest.predict(forest.fit_forest(table, FEATURES, TARGETS, "k", p, 3), table.na.drop(), ["fold", *TARGETS],
                               own_fold=True)
        for t in TARGETS:
            error = (F.floor(F.col(t) * 1e6 + 0.5) / 1e6 - F.col(f"pred_{t}")) ** 2
            mse = found.groupBy("fold").agg(F.avg(error).alias("e")).agg(F.avg("e")).first()[0]
            assert got[depth, trees, str(drawn), leaf, 0, size, t] == pytest.approx(mse)
    assert replace(forest.BEST, max_features="sqrt").features_per_split(18) == 4


def test_empty_table(table):
    found = forest.fit_forest(table.limit(0), FEATURES, TARGETS, "k", forest.Params(2, 2))
    assert found.nodes.count() == 0
