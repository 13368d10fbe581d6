"""Random forests with shared splits for all targets, and their grid search.

Features are cut into ``bins`` of equal width between their least and greatest
training value, targets are counted in millionths, so every sum is a whole number
and a forest does not depend on the order of its rows. A tree draws each row
0, 1, 2, ... times (Poisson, from a hash of the row's key) and each node
``max_features`` of the features (hash of tree and node); a split is the one that
lowers the squared error, summed over the targets, most.

Trees grow level by level. ``grow_by_levels`` takes one grouped aggregate over
tree x node x feature x bin for all trees at once, so the number of jobs follows
the depth, not the number of trees, and the rows stay where they are. A training
table of at most ``LOCAL_CELLS`` cells (a checked size) is sent whole to the tasks
instead, each of which grows its share of the trees (``grow_in_tasks``): the same
nodes, as the tests show.

Nested evaluation: the first n trees of a forest are the n-tree forest, a tree cut
at depth d is its depth-d tree, and one that stops at nodes of fewer than m rows
is its minimum-split-m tree. So all tree counts, depths and split sizes of a grid
come from one fit each of the other parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeris.operators.clean import complete_cases
from aeris.session import ensure_checkpoint_dir

UNITS = 1_000_000
# Cells (rows x features) of the largest training table that is sent whole to tasks.
LOCAL_CELLS = 1 << 26
# Trees that a task grows before it writes them.
TREE_BLOCK = 25
# A split must lower the squared error by more than rounding can.
LEAST_GAIN = 1e-9
# A draw below the k-th number of 65536ths makes fewer than k copies
# (the distribution function of a Poisson variable of mean 1).
POISSON = [24109, 48218, 60272, 64290, 65295, 65495, 65529]


@dataclass(frozen=True)
class Params:
    """``max_features``: a number (more than there are means all) or "sqrt"."""

    max_depth: int = 7
    n_estimators: int = 200
    max_features: int | str = 10
    min_samples_leaf: int = 1
    min_samples_split: int = 5
    random_state: int = 42
    bins: int = 32

    def features_per_split(self, n: int) -> int:
        return max(1, int(n ** 0.5)) if self.max_features == "sqrt" else min(int(self.max_features), n)


# The stored best grid point.
BEST = Params(max_depth=7, n_estimators=200, max_features=10, min_samples_leaf=1, min_samples_split=5,
              random_state=42)
# The grid that is searched.
GRID = {"max_depth": [3, 5, 7, 10], "n_estimators": [100, 200, 300, 400, 500],
        "max_features": [10, 20, 30, 40, "sqrt"], "min_samples_leaf": [1, 2, 4],
        "random_state": [0, 42], "min_samples_split": [2, 5]}


@dataclass(frozen=True)
class Cuts:
    """Where the bins of each feature lie."""

    features: tuple
    low: tuple
    high: tuple
    bins: int

    def column(self) -> Column:
        """The bins of a row as an array."""
        out = []
        for f, lo, hi in zip(self.features, self.low, self.high):
            share = (F.col(f).cast("double") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
            # rounded first: a share on a bin's edge must not depend on its last digit
            share = F.floor(share * float(UNITS) + 0.5) / float(UNITS)
            out.append(F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), F.floor(share * self.bins).cast("int"))))
        return F.array(*out)


def cuts_of(train: DataFrame, features, bins: int) -> Cuts:
    row = train.agg(*[a(F.col(f).cast("double")).alias(f"{n}_{i}") for i, f in enumerate(features)
                      for n, a in (("lo", F.min), ("hi", F.max))]).first()
    ends = [[float(row[f"{n}_{i}"] or 0.0) for i in range(len(features))] for n in ("lo", "hi")]
    return Cuts(tuple(features), tuple(ends[0]), tuple(ends[1]), bins)


def binned(df: DataFrame, cuts: Cuts, targets, key: str, keep=()) -> DataFrame:
    """(k, fold, b, y) and ``keep``: the key as text, bins, targets in millionths."""
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(None).cast("int")
    y = F.array(*[F.floor(F.col(t).cast("double") * float(UNITS) + 0.5).cast("long") for t in targets])
    return df.select(*keep, F.col(key).cast("string").alias("k"), fold.alias("fold"), cuts.column().alias("b"),
                     y.alias("y"))


@dataclass
class Forest:
    """``nodes``: (g, node, n, w, s array, feature, bin, gain), g = fold x trees + tree;
    node 1 is the root and the children of i are 2i and 2i + 1."""

    nodes: DataFrame
    cuts: Cuts
    targets: list
    params: Params
    folds: int | None = None


NODE_SCHEMA = "g int, node int, n long, w long, s array<long>, feature int, bin int, gain double"


def fit_forest(train: DataFrame, features, targets, key: str = "date", params: Params = BEST,
               folds: int | None = None, local_cells: int = LOCAL_CELLS) -> Forest:
    """One forest on all complete rows, or with ``folds`` one forest per value of the
    column ``fold``, grown on the rows of the other folds."""
    data = complete_cases(train, list(features) + list(targets))
    cuts = cuts_of(data, features, params.bins)
    rows = binned(data, cuts, targets, key)
    if data.count() * len(features) <= local_cells:
        nodes = grow_in_tasks(rows, params, len(features), folds)
    else:
        nodes = grow_by_levels(rows, params, len(features), len(targets), folds)
    ensure_checkpoint_dir(train.sparkSession)
    return Forest(nodes.checkpoint(eager=True), cuts, list(targets), params, folds)


# --- level by level -------------------------------------------------------------------


def copies(seed: int, tree: Column, key: Column) -> Column:
    """How often a tree draws a row."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.floor(tree / 8).cast("string"), key))
    draw = F.conv(F.substr(text, tree % 8 * 4 + 1, F.lit(4)), 16, 10).cast("int")
    return sum([(draw >= c).cast("long") for c in POISSON], F.lit(0).cast("long"))


def subset(seed: int, tree: Column, node: Column, n_features: int, k: int) -> Column:
    """The features that a node may split on."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda f: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), node.cast("string"), f.cast("string"))).alias("h"),
        f.alias("f")))
    return F.transform(F.slice(F.array_sort(drawn), 1, k), lambda x: x["f"])


def _error_removed(w: Column, sums: list[Column]) -> Column:
    return sum([s.cast("double") * s.cast("double") / w for s in sums[1:]],
               sums[0].cast("double") * sums[0].cast("double") / w)


def grow_by_levels(rows: DataFrame, params: Params, n_features: int, n_targets: int,
                   folds: int | None = None) -> DataFrame:
    """The nodes of all trees, one grouped aggregate a level."""
    p, trees = params, params.n_estimators
    k = p.features_per_split(n_features)
    g = F.explode(F.sequence(F.lit(0), F.lit(trees * (folds or 1) - 1))).alias("g")
    at = rows.select("k", "fold", "b", "y", g)
    tree = F.col("g") % trees
    if folds:
        at = at.where(F.col("fold") != F.floor(F.col("g") / trees))
    at = at.select("g", F.lit(1).alias("node"), "b", "y", copies(p.random_state, tree, F.col("k")).alias("w"))
    at = at.where("w > 0")
    names, levels = [f"s{t}" for t in range(n_targets)], []
    sums = [F.sum(F.col("w") * F.col("y")[t]).alias(c) for t, c in enumerate(names)]
    for depth in range(p.max_depth + 1):
        if depth == p.max_depth:
            last = at.groupBy("g", "node").agg(F.count("*").alias("n"), F.sum("w").alias("w"), *sums)
            levels.append(last.withColumn("best", F.lit(None).cast("struct<gain:double,feature:int,bin:int>")))
            break
        cells = at.select("g", "node", "w", "y", F.posexplode("b").alias("feature", "bin"))
        # at most trees x nodes x features x bins rows, however many the table has
        cells = cells.groupBy("g", "node", "feature", "bin").agg(
            F.count("*").alias("n"), F.sum("w").alias("w"), *sums).checkpoint(eager=True)
        stats = cells.where("feature = 0").groupBy("g", "node").agg(*[F.sum(c).alias(c) for c in ("n", "w", *names)])
        drawn = stats.where(F.col("n") >= p.min_samples_split).select("g", "node", F.explode(
            subset(p.random_state, tree, F.col("node"), n_features, k)).alias("feature"))
        by_bin = Window.partitionBy("g", "node", "feature").orderBy("bin")
        whole = Window.partitionBy("g", "node", "feature")
        left = cells.join(drawn, ["g", "node", "feature"]).select(
            "g", "node", "feature", "bin", *[F.sum(c).over(by_bin).alias(c) for c in ("n", "w", *names)],
            *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("n", "w", *names)])
        both = left.where((F.col("n") >= p.min_samples_leaf) & (F.col("n_all") - F.col("n") >= p.min_samples_leaf)
                          & (F.col("n") < F.col("n_all")))
        removed = _error_removed(F.col("w"), [F.col(c) for c in names]) + _error_removed(
            F.col("w_all") - F.col("w"), [F.col(f"{c}_all") - F.col(c) for c in names])
        before = _error_removed(F.col("w_all"), [F.col(f"{c}_all") for c in names])
        best = both.select("g", "node", "feature", "bin", removed.alias("score"), before.alias("before")).where(
            F.col("score") > F.col("before") * (1 + LEAST_GAIN))
        best = best.groupBy("g", "node").agg(F.max(F.struct(
            "score", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "before")).alias("x"))
        best = best.select("g", "node", F.struct(
            (F.col("x.score") - F.col("x.before")).alias("gain"), (-F.col("x.f")).cast("int").alias("feature"),
            (-F.col("x.b")).cast("int").alias("bin")).alias("best")).checkpoint(eager=True)
        levels.append(stats.join(best, ["g", "node"], "left"))
        # at most trees x nodes rows: bounded by the parameters
        down = F.broadcast(best.select("g", "node", "best"))
        at = at.join(down, ["g", "node"]).select("g", (F.col("node") * 2 + F.when(
            F.get("b", F.col("best.feature")) > F.col("best.bin"), 1).otherwise(0)).alias("node"), "b", "y", "w")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select(F.col("g").cast("int").alias("g"), F.col("node").cast("int").alias("node"), "n", "w",
                      F.array(*names).alias("s"), "best.feature", "best.bin", "best.gain")


# --- in tasks -------------------------------------------------------------------------


def _draws(seed: int, trees: range, keys: list[str]) -> np.ndarray:
    """(tree, row): how often each tree draws each row."""
    found = {}
    for group in {t // 8 for t in trees}:
        text = b"".join(md5(f"{seed}:{group}:{k}".encode()).digest() for k in keys)
        found[group] = np.frombuffer(text, dtype=">u2").reshape(-1, 8)
    return np.stack([np.searchsorted(POISSON, found[t // 8][:, t % 8], side="right") for t in trees])


@cache
def _order(seed: int, tree: int, node: int, n_features: int) -> tuple[int, ...]:
    """The features in the order in which a node draws them."""
    return tuple(sorted(range(n_features), key=lambda f: (md5(f"{seed}:{tree}:{node}:{f}".encode()).hexdigest(), f)))


def grow_tree(b: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, params: Params) -> dict[str, np.ndarray]:
    """Columns node, n, w, s, feature (-1 for none), bin, gain of one tree."""
    p, n_features = params, b.shape[1]
    k, bins = p.features_per_split(n_features), p.bins
    drawn = w > 0
    b, y, w = b[drawn].astype(np.int64), y[drawn].astype(np.float64), w[drawn].astype(np.float64)
    node = np.ones(len(b), dtype=np.int64)
    levels: list[tuple] = []
    for depth in range(p.max_depth + 1):
        if not len(node):
            break
        ids, at = np.unique(node, return_inverse=True)
        m = len(ids)
        weights = [None, w, *(w * y[:, t] for t in range(y.shape[1]))]
        totals = np.stack([np.bincount(at, x, m).astype(np.float64) for x in weights])  # whole numbers, exact
        feature, cut, gain = np.full(m, -1), np.full(m, -1), np.zeros(m)
        large = totals[0] >= p.min_samples_split
        if depth < p.max_depth and large.any():
            cell = (at[:, None] * n_features + np.arange(n_features)) * bins + b
            size = m * n_features * bins
            left = np.stack([np.bincount(cell.ravel(), None if x is None else np.repeat(x, n_features), size)
                             for x in weights]).reshape(-1, m, n_features, bins).cumsum(axis=3)[..., :-1]
            right = totals[:, :, None, None] - left
            allowed = np.zeros((m, n_features), dtype=bool)
            for i in np.flatnonzero(large):
                if k < n_features:
                    allowed[i, list(_order(p.random_state, tree, int(ids[i]), n_features)[:k])] = True
                else:
                    allowed[i] = True
            fits = (left[0] >= max(1, p.min_samples_leaf)) & (right[0] >= max(1, p.min_samples_leaf)) & allowed[:, :, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = _removed(left) + _removed(right)
                before = _removed(totals)
            score = np.where(fits, score, -np.inf).reshape(m, -1)
            best = score.argmax(axis=1)  # the first: least feature, then least bin
            most = score[np.arange(m), best]
            split = most > before * (1 + LEAST_GAIN)
            feature = np.where(split, best // (bins - 1), -1)
            cut = np.where(split, best % (bins - 1), -1)
            gain = np.where(split, most - before, 0.0)
        levels.append((ids, *totals[:2], totals[2:].T, feature, cut, gain))
        going = feature[at] >= 0
        b, y, w, node, at = b[going], y[going], w[going], node[going], at[going]
        node = node * 2 + (b[np.arange(len(b)), feature[at]] > cut[at])
    names = ("node", "n", "w", "s", "feature", "bin", "gain")
    return {c: np.concatenate([level[i] for level in levels]) for i, c in enumerate(names)} if levels else {}


def _removed(x: np.ndarray) -> np.ndarray:
    """Sum over the targets of squared sum / weight, for stacked n, w, sums."""
    out = x[2] * x[2] / x[1]
    for t in range(3, len(x)):
        out = out + x[t] * x[t] / x[1]
    return out


def _whole_table(rows: DataFrame) -> DataFrame:
    """One row with the columns of all rows, by key. For tables of a checked size."""
    one = rows.agg(F.array_sort(F.collect_list(F.struct("k", "fold", "b", "y"))).alias("t"))
    return one.select(F.col("t.k").alias("k"), F.col("t.fold").alias("fold"), F.flatten("t.b").alias("b"),
                      F.flatten("t.y").alias("y"))


def _in_tasks(rows: DataFrame, blocks: int, work, schema: str) -> DataFrame:
    """``work(block, keys, folds, b, y)`` for each block of trees, the table beside it."""
    spark = rows.sparkSession
    numbered = spark.range(blocks).repartition(blocks, "id").select("id", F.lit(1).alias("one"))
    # LOCAL_CELLS bounds this side; its callers have counted it
    table = F.broadcast(_whole_table(rows).withColumn("one", F.lit(1)))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("k")[i].as_py()
                if not keys:
                    continue
                folds = batch.column("fold")[i].values.to_numpy(zero_copy_only=False)
                b, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(len(keys), -1) for c in "by")
                yield from work(batch.column("id")[i].as_py(), keys, folds, b, y)
    return numbered.join(table, "one").drop("one").mapInArrow(run, schema)


def grow_in_tasks(rows: DataFrame, params: Params, n_features: int, folds: int | None = None) -> DataFrame:
    """The nodes of all trees, each tree grown by one task."""
    trees = params.n_estimators

    def work(block, keys, fold, b, y):
        some = range(block * TREE_BLOCK, min(trees, (block + 1) * TREE_BLOCK))
        for tree, w in zip(some, _draws(params.random_state, some, keys)):
            for f in range(folds or 1):
                found = grow_tree(b, y, np.where(fold == f, 0, w) if folds else w, tree, params)
                if found:
                    yield _node_batch(f * trees + tree, found)
    return _in_tasks(rows, -(-trees // TREE_BLOCK), work, NODE_SCHEMA)


def _node_batch(g: int, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    whole, none = found["s"].astype(np.int64), found["feature"] < 0
    ends = np.arange(len(whole) + 1, dtype=np.int32) * whole.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(whole), g, dtype=np.int32)), pa.array(found["node"].astype(np.int32)),
         pa.array(found["n"].astype(np.int64)), pa.array(found["w"].astype(np.int64)),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.ravel())),
         *[pa.array(found[c].astype(t), mask=none) for c, t in (("feature", np.int32), ("bin", np.int32),
                                                                ("gain", np.float64))]],
        ["g", "node", "n", "w", "s", "feature", "bin", "gain"])


# --- scoring --------------------------------------------------------------------------


class _Tree:
    """A tree as arrays by node number."""

    def __init__(self, found: dict[str, np.ndarray]):
        size = int(found["node"].max()) + 1
        self.feature, self.cut, self.n = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        self.value = np.zeros((size, found["s"].shape[1]))
        at = found["node"].astype(np.int64)
        self.feature[at], self.cut[at], self.n[at] = found["feature"], found["bin"], found["n"]
        self.value[at] = found["s"] / found["w"][:, None] / UNITS

    def walk(self, b: np.ndarray, depths, least: int = 0):
        """(depth, values) at each of ``depths``, in order; nodes of fewer than ``least`` rows are leaves."""
        node, rows = np.ones(len(b), dtype=np.int64), np.arange(len(b))
        for depth in range(max(depths) + 1):
            if depth in depths:
                yield depth, self.value[node]
            goes = (self.feature[node] >= 0) & (self.n[node] >= least)
            here = node[goes]
            node[goes] = here * 2 + (b[rows[goes], self.feature[here]] > self.cut[here])


def _trees(nodes: DataFrame) -> dict[int, _Tree]:
    """All trees of a forest: at most trees x 2^(depth + 1) nodes, bounded by the parameters."""
    table = nodes.toArrow()
    g = table.column("g").to_numpy()
    order = np.argsort(g, kind="stable")
    flat = {c: table.column(c).to_numpy()[order] for c in ("node", "n", "w")}
    flat["s"] = np.asarray(table.column("s").combine_chunks().flatten().to_numpy()).reshape(len(g), -1)[order]
    for c in ("feature", "bin"):
        flat[c] = table.column(c).fill_null(-1).to_numpy()[order]
    ids, starts = np.unique(g[order], return_index=True)
    return {int(i): _Tree({c: x[lo:hi] for c, x in flat.items()})
            for i, lo, hi in zip(ids, starts, [*starts[1:], len(g)])}


def predict(forest: Forest, df: DataFrame, keep=("date",), own_fold: bool = False) -> DataFrame:
    """``keep`` and pred_<target> of the complete rows of ``df``: the mean over the trees.

    With ``own_fold`` a row is predicted by the forest that did not see its fold, else
    every fold's forest gives a row, in a column ``forest``."""
    trees, p, k = _trees(forest.nodes), forest.params, len(forest.targets)
    folds = forest.folds or 1
    keep = list(keep)
    rows = complete_cases(df, list(forest.cuts.features)).withColumn("_b", forest.cuts.column())
    if forest.folds:
        every = F.array(F.col("fold").cast("int")) if own_fold else F.sequence(F.lit(0), F.lit(folds - 1))
        rows = rows.withColumn("forest", F.explode(every))
    else:
        rows = rows.withColumn("forest", F.lit(0))
    preds = [f"pred_{t}" for t in forest.targets]
    out = rows.select("_b", *keep, *(["forest"] if "forest" not in keep else []))

    def run(batches):
        for batch in batches:
            b = batch.column("_b").flatten().to_numpy().reshape(batch.num_rows, -1)
            which = batch.column("forest").to_numpy()
            total = np.zeros((batch.num_rows, k))
            for f in np.unique(which):
                mine = which == f
                for tree in range(p.n_estimators):
                    if f * p.n_estimators + tree in trees:
                        for _, values in trees[f * p.n_estimators + tree].walk(b[mine], (p.max_depth,)):
                            total[mine] += values
            total /= p.n_estimators
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], batch.column("forest"), *[pa.array(total[:, t]) for t in range(k)]],
                [*keep, "forest", *preds])
    kinds = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in [*keep, "forest"])
    found = out.mapInArrow(run, f"{kinds}, " + ", ".join(f"`{c}` double" for c in preds))
    return found if forest.folds else found.drop("forest")


def importances(forest: Forest) -> DataFrame:
    """(feature, importance), most important first (K8): the mean over the trees of the
    share of the lowered squared error that splits on the feature have."""
    per_tree = Window.partitionBy("g")
    share = forest.nodes.where("gain is not null").select(
        "g", "feature", (F.col("gain") / F.sum("gain").over(per_tree)).alias("share"))
    trees = forest.nodes.agg(F.count_distinct("g")).scalar()
    summed = share.groupBy("feature").agg((F.sum("share") / trees).alias("importance"))
    names = forest.nodes.sparkSession.createDataFrame(
        list(enumerate(forest.cuts.features)), "feature int, name string")
    out = names.join(summed, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return out.orderBy(F.desc("importance"), "feature")


def fold_errors(train: DataFrame, features, targets, key: str = "date", params: Params = BEST,
                folds: int = 5, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """(fold, part, mse): error of each fold's forest on the rows it saw (train) and on
    the others (val), from one growth of all folds and one scoring pass (M13)."""
    forest = fit_forest(train, features, targets, key, params, folds, local_cells)
    scored = predict(forest, complete_cases(train, list(features) + list(targets)), ["fold", *targets])
    error = sum([(F.col(t).cast("double") - F.col(f"pred_{t}")) ** 2 for t in targets], F.lit(0.0)) / len(targets)
    part = F.when(F.col("fold") == F.col("forest"), "val").otherwise("train")
    return scored.groupBy(F.col("forest").alias("fold"), part.alias("part")).agg(F.avg(error).alias("mse"))


# --- grid -----------------------------------------------------------------------------


def grid_search(train: DataFrame, features, targets, key: str = "date", folds: int = 3,
                grid: dict | None = None, bins: int = 32, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The mean over the folds of the validation error of every point of ``grid``
    (default ``GRID``), by target: (the parameters, target, mse).

    Every tree count, depth and split size is read off one forest for each of the
    other parameters and each fold."""
    grid = GRID | (grid or {})
    data = complete_cases(train, list(features) + list(targets))
    n_features, cuts = len(features), cuts_of(data, features, bins)
    rows = binned(data, cuts, targets, key)
    counts = sorted(grid["n_estimators"])
    block = int(np.gcd.reduce([*counts, 2 * TREE_BLOCK]))  # trees that a sum is over
    most = Params(max(grid["max_depth"]), counts[-1], min_samples_split=min(grid["min_samples_split"]), bins=bins)
    sizes = {replace(most, max_features=m).features_per_split(n_features) for m in grid["max_features"]}
    fits = [replace(most, max_features=m, min_samples_leaf=leaf) for m, leaf in
            product(sorted(sizes), grid["min_samples_leaf"])]
    if data.count() * n_features <= local_cells:
        sums = _sums_in_tasks(rows, fits, grid, block, folds, len(targets))
    else:
        sums = _sums_by_levels(rows, fits, grid, block, folds, n_features, len(targets))
    key_cols = [*_SUM_KEYS[:-1], "k"]
    per_row = sums.groupBy(*key_cols).agg(*[F.sum(F.when(F.col("block") < c // block, F.col(f"p{t}"))).alias(f"p{t}_{c}")
                                            for t in range(len(targets)) for c in counts])
    known = rows.select("k", "fold", "y")
    error = F.array(*[F.struct(F.lit(c).alias("n_estimators"), F.lit(name).alias("target"), F.pow(
        F.col(f"p{t}_{c}") / c - F.col("y")[t] / float(UNITS), F.lit(2.0)).alias("e"))
        for t, name in enumerate(targets) for c in counts])
    errors = per_row.join(known, "k").select(*key_cols[:-1], "fold", F.explode(error).alias("x"))
    errors = errors.groupBy(*key_cols[:-1], "x.n_estimators", "x.target", "fold").agg(F.avg("x.e").alias("mse"))
    errors = errors.groupBy(*key_cols[:-1], "n_estimators", "target").agg(F.avg("mse").alias("mse"))
    # points whose max_features draw as many features are the same forest
    named = [(str(m), replace(most, max_features=m).features_per_split(n_features)) for m in grid["max_features"]]
    named = train.sparkSession.createDataFrame(named, "max_features string, drawn int")
    return errors.join(named, "drawn").select("max_depth", "n_estimators", "max_features", "min_samples_leaf",
                                              "random_state", "min_samples_split", "target", "mse")


_SUM_KEYS = ["random_state", "drawn", "min_samples_leaf", "max_depth", "min_samples_split", "block"]


def _sum_schema(n_targets: int) -> str:
    return ", ".join(f"{c} int" for c in _SUM_KEYS) + ", k string" + "".join(f", p{t} double" for t in range(n_targets))


class _Sums:
    """Sums of a block's predictions by depth and split size, for the rows its trees did not see."""

    def __init__(self, fit: Params, grid: dict, part: int, rows: int, n_targets: int):
        self.depths, self.splits = sorted(grid["max_depth"]), grid["min_samples_split"]
        self.fit, self.part = fit, part
        self.total = np.zeros((len(self.depths), len(self.splits), rows, n_targets))

    def add(self, tree: _Tree, b: np.ndarray, rows: np.ndarray) -> None:
        for j, least in enumerate(self.splits):
            for i, (_, values) in enumerate(tree.walk(b[rows], self.depths, least)):
                self.total[i, j, rows] += values

    def batches(self, keys: pa.Array):
        n, n_targets = self.total.shape[2:]
        for (i, depth), (j, least) in product(enumerate(self.depths), enumerate(self.splits)):
            numbers = (self.fit.random_state, self.fit.max_features, self.fit.min_samples_leaf, depth, least, self.part)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(np.full(n, x, dtype=np.int32)) for x in numbers], keys,
                 *[pa.array(self.total[i, j, :, t]) for t in range(n_targets)]],
                [*_SUM_KEYS, "k", *[f"p{t}" for t in range(n_targets)]])


def _sums_in_tasks(rows: DataFrame, fits, grid, block: int, folds: int, n_targets: int) -> DataFrame:
    """(parameters, block, k, sums): a task grows one block of trees of every fit."""
    blocks, seeds = fits[0].n_estimators // block, grid["random_state"]

    def work(number, keys, fold, b, y):
        seed, part = seeds[number // blocks], number % blocks
        some = range(part * block, (part + 1) * block)
        draws = _draws(seed, some, keys)
        for fit in fits:
            fit = replace(fit, random_state=seed)
            sums = _Sums(fit, grid, part, len(keys), n_targets)
            for f in range(folds):
                unseen = np.flatnonzero(fold == f)
                for tree, w in zip(some, draws):
                    found = grow_tree(b, y, np.where(fold == f, 0, w), tree, fit)
                    if found:
                        sums.add(_Tree(found), b, unseen)
            yield from sums.batches(pa.array(keys))
        _order.cache_clear()
    return _in_tasks(rows, len(seeds) * blocks, work, _sum_schema(n_targets))


def _sums_by_levels(rows: DataFrame, fits, grid, block: int, folds: int, n_features: int, n_targets: int) -> DataFrame:
    """The same sums from forests that grow level by level; the rows stay where they are."""
    out = None
    for seed, fit in product(grid["random_state"], fits):
        fit = replace(fit, random_state=seed)
        nodes = grow_by_levels(rows, fit, n_features, n_targets, folds).checkpoint(eager=True)
        trees, n = _trees(nodes), fit.n_estimators

        def run(batches, trees=trees, fit=fit, n=n):
            for batch in batches:
                b = batch.column("b").flatten().to_numpy().reshape(batch.num_rows, -1)
                fold = batch.column("fold").to_numpy()
                for part in range(n // block):
                    sums = _Sums(fit, grid, part, len(b), n_targets)
                    for f, tree in product(np.unique(fold).tolist(), range(part * block, (part + 1) * block)):
                        if f * n + tree in trees:
                            sums.add(trees[f * n + tree], b, np.flatnonzero(fold == f))
                    yield from sums.batches(batch.column("k"))
        one = rows.select("k", "fold", "b").mapInArrow(run, _sum_schema(n_targets))
        out = one if out is None else out.unionByName(one)
    return out
