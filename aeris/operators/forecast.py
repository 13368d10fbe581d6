"""Sequence forecaster (M15, re-aimed) and the k-day forecast view.

The neural sequence model becomes ridge regression on windows: a sample is the
``length`` previous days x features, its label the day's 7-day mean. A window is never
written out as one wide row.

Fit: the products of two window cells depend on the older row of the two and on their
distance, but for the days at which samples begin and end. With w(t) = 1 where day t is
a sample, the sum of x(t-a) x(t-a-d) over all samples is

    S(d, a) = sum over s of w(s + a) x(s) x(s - d),    S(d, a + 1) = S(d, a) + E(d, a),
    E(d, a) = sum over s of (w(s + a + 1) - w(s + a)) x(s) x(s - d)

so one pass gives S(d, 1) from every row and E(d, a) from the rows near an edge: the
first samples of an entity, the last, and those beside a missing label. Only the
moments, (length x features)^2 numbers whatever the table's size, reach the driver.

Prediction: a row's part in each of the next ``length`` forecasts is one number, and a
forecast adds up the parts of the rows before it.

Defined results: a missing feature counts as 0; a day without ``length`` predecessors in
its entity is no sample; a missing label takes its day out of that label's fit; a window
cell that never varies gets coefficient 0; no sample at all raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeris.operators.linear import Moments
from aeris.operators.ordered import (DEFAULT_BLOCK_ROWS, ROW_ID, _BLK, _HOME, _cols, _ensure_index, blocked,
                                     first_k)


@dataclass
class SequenceModel:
    """coef[a - 1, f] is the weight of feature f, a days before the forecast day."""

    features: list
    label: str
    coef: np.ndarray
    intercept: float


def _far(cols, centre):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(x)) for c, x in zip(cols, centre)])


def _centre(df: DataFrame, features, labels) -> tuple[np.ndarray, np.ndarray]:
    row = df.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"x{i}") for i, c in enumerate(features)],
                 *[F.avg(F.col(c).cast("double")).alias(f"y{i}") for i, c in enumerate(labels)]).first()
    return (np.array([row[f"x{i}"] or 0.0 for i in range(len(features))]),
            np.array([row[f"y{i}"] or 0.0 for i in range(len(labels))]))


def lagged_products(df: DataFrame, features, labels, length: int, centres, order="date", partition_by=None,
                    block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = ROW_ID) -> DataFrame:
    """(k, e, d, f, n0, n1, ...) for label number k, of distances from the centres.

    e = 0: S(d, 1); e = 1, 2, ...: E(d, e). f is the feature of the newer row, n0 the sum
    of its value alone, n1 and on its products with the features of the older row.
    e = -1 holds the labels: the sums of y (f = 0), y squared (1) and 1 (2), and their
    products with the features d days before."""
    pb, features, labels = _cols(partition_by), _cols(features), _cols(labels)
    cx, cy = centres
    indexed = _ensure_index(df, order, pb, id_col)
    at = Window.partitionBy(*pb, _BLK).orderBy(id_col)
    b = blocked(indexed, length, block_rows, id_col, ahead=length).select(
        *pb, _BLK, _HOME, id_col, _far(features, cx).alias("_x"),
        F.array(*[F.col(c).cast("double") - F.lit(float(y)) for c, y in zip(labels, cy)]).alias("_y"))
    b = b.withColumn("_whole", F.lag(F.lit(1), length).over(at).isNotNull())
    b = b.withColumn("_w", F.transform("_y", lambda y: (F.col("_whole") & y.isNotNull()).cast("int")))
    b = b.withColumn("_next", F.collect_list("_w").over(at.rowsBetween(1, length))) \
         .withColumn("_past", F.collect_list("_x").over(at.rowsBetween(-length, 0))).where(F.col(_HOME))

    def weight(k, a):  # w(s + a) of label k; there is no sample after the last row
        return F.coalesce(F.get(F.get("_next", F.lit(a - 1)), F.lit(k)), F.lit(0))

    def times(turn):
        return F.transform("_x", lambda x: x * turn)

    def part(k, e, values, last, wanted):
        return F.struct(F.lit(k).alias("k"), F.lit(e).alias("e"), values.alias("v"), F.lit(last).alias("last"),
                        wanted.alias("wanted"))

    parts = []
    for k in range(len(labels)):
        for e in range(length):
            turn = weight(k, 1) if e == 0 else weight(k, e + 1) - weight(k, e)
            parts.append(part(k, e, times(turn), length - 1 - e, turn != 0))
        y = F.get("_y", F.lit(k))
        parts.append(part(k, -1, F.array(y, y * y, F.lit(1.0)), length, F.get("_w", F.lit(k)) == 1))
    # of the older row only its values travel, not the window
    cells = F.flatten(F.transform(F.filter(F.array(*parts), lambda p: p["wanted"]), lambda p: F.transform(
        F.sequence(F.lit(0), p["last"]), lambda d: F.struct(
            p["k"].alias("k"), p["e"].alias("e"), d.alias("d"), p["v"].alias("v"),
            F.get("_past", F.size("_past") - 1 - d).alias("u")))))
    rows = b.select(F.inline(cells)).select("k", "e", "d", "u", F.posexplode("v").alias("f", "v"))
    return rows.groupBy("k", "e", "d", "f").agg(
        F.sum("v").alias("n0"), *[F.sum(F.col("v") * F.col("u")[g]).alias(f"n{g + 1}") for g in range(len(features))])


def window_moments(df: DataFrame, features, labels, length: int, order="date", partition_by=None,
                   block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = ROW_ID) -> dict[str, Moments]:
    """Per label the moments of (window cells, label) over its samples. Cell
    (a - 1) * len(features) + f is feature f, a days before."""
    features, labels = _cols(features), _cols(labels)
    size = len(features)
    cx, cy = centres = _centre(df, features, labels)
    rows = lagged_products(df, features, labels, length, centres, order, partition_by, block_rows, id_col).collect()
    edge = np.zeros((len(labels), length, length, size, size + 1))  # k, e, d, f
    head = np.zeros((len(labels), length + 1, 3, size + 1))  # k, d, what
    for r in rows:  # at most labels x length^2 x features, whatever the table's size
        values = [r[f"n{g}"] or 0.0 for g in range(size + 1)]
        if r["e"] < 0:
            head[r["k"], r["d"], r["f"]] = values
        else:
            edge[r["k"], r["e"], r["d"], r["f"]] = values
    summed = np.cumsum(edge, axis=1)  # S(d, a) at index a - 1
    p = length * size
    out = {}
    for k, label in enumerate(labels):
        m, s = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
        for a in range(length):
            here = slice(a * size, (a + 1) * size)
            s[here] = summed[k, a, 0, :, 0]
            m[here, p] = m[p, here] = head[k, a + 1, 0, 1:]
            for d in range(length - a):
                there = slice((a + d) * size, (a + d + 1) * size)
                m[here, there] = summed[k, a, d, :, 1:]
                m[there, here] = m[here, there].T
        s[p], m[p, p] = head[k, 0, 0, 0], head[k, 0, 1, 0]
        out[label] = Moments(head[k, 0, 2, 0], s, m, np.concatenate([np.tile(cx, length), cy[k:k + 1]]))
    return out


def covariances(moments: dict[str, Moments], features, length: int) -> list[tuple]:
    """(label, lag, feature, lag_2, feature_2, cov) of every pair of cells and of the
    label, at lag 0, with each of them and itself."""
    names = [(a, f) for a in range(1, length + 1) for f in _cols(features)]
    out = []
    for label, x in moments.items():
        mean = x.s / x.n
        cov, named = x.m / x.n - np.outer(mean, mean), [*names, (0, label)]
        out += [(label, *named[i], *named[j], float(cov[i, j])) for i in range(len(named)) for j in range(i, len(named))]
    return out


def solve_windows(x: Moments, features, label: str, length: int, reg: float) -> SequenceModel:
    """Least 1/(2n) ||y - Xw - b||^2 + reg / (2 sd(y)) * sum of (sd(x) w)^2, so a
    column's unit does not matter; deviations over n."""
    if x.n == 0:
        raise ValueError(f"no window of {length} rows has a label {label}")
    mean = x.s / x.n
    cov = x.m / x.n - np.outer(mean, mean)
    mean = mean + x.centre
    p = len(mean) - 1
    sxx, sxy, spread = cov[:p, :p], cov[:p, p], np.maximum(np.diag(cov), 0.0)
    steady = np.flatnonzero(spread[:p] > 1e-12 * max(spread[:p].max(initial=0.0), 1e-300))
    w = np.zeros(p)
    if len(steady) and spread[p] > 0:
        ridge = np.diag(reg / np.sqrt(spread[p]) * spread[steady])
        w[steady] = np.linalg.lstsq(sxx[np.ix_(steady, steady)] + ridge, sxy[steady], rcond=None)[0]
    return SequenceModel(list(features), label, w.reshape(length, -1), float(mean[p] - mean[:p] @ w))


def fit_sequence_models(train: DataFrame, features, labels, length: int, order="date", partition_by=None,
                        reg: float = 0.1, block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = ROW_ID) -> dict:
    """One model per label, all from one aggregate over ``train`` (rows in ``order``; a
    row index that it brings must be dense within an entity)."""
    features, labels = _cols(features), _cols(labels)
    moments = window_moments(train, features, labels, length, order, partition_by, block_rows, id_col)
    return {y: solve_windows(moments[y], features, y, length, reg) for y in labels}


def predict_sequences(models: dict, df: DataFrame, order="date", partition_by=None, keep=("date",),
                      block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = ROW_ID) -> DataFrame:
    """``keep`` and pred_<label> of every row that has a whole window before it."""
    pb = _cols(partition_by)
    length = max(m.coef.shape[0] for m in models.values())
    b = blocked(_ensure_index(df, order, pb, id_col), length, block_rows, id_col)
    parts = {}
    for y, m in models.items():
        zero = np.zeros(len(m.features))
        x = _far(m.features, zero)
        parts[f"_part_{y}"] = F.array(*[F.aggregate(
            F.zip_with(x, F.array(*[F.lit(float(c)) for c in row]), lambda u, v: u * v),
            F.lit(0.0), lambda acc, v: acc + v) for row in m.coef])
    at = Window.partitionBy(*pb, _BLK).orderBy(id_col)
    b = b.select(*dict.fromkeys([*pb, _BLK, _HOME, id_col, *keep]), *[c.alias(n) for n, c in parts.items()])
    preds = [sum((F.lag(F.get(f"_part_{y}", F.lit(a)), a + 1).over(at) for a in range(m.coef.shape[0])),
                 F.lit(m.intercept)).alias(f"pred_{y}") for y, m in models.items()]
    whole = F.lag(F.lit(1), length).over(at).isNotNull()
    return b.select(*keep, _HOME, whole.alias("_whole"), *preds).where(F.col(_HOME) & F.col("_whole")).select(
        *keep, *labels_of(models))


def labels_of(models: dict) -> list[str]:
    return [f"pred_{y}" for y in models]


def next_days(predictions: DataFrame, k: int = 3, date: str = "date") -> DataFrame:
    """The first ``k`` forecast days (top-k by date)."""
    return first_k(predictions, k, date)
