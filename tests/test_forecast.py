"""Sequence forecaster (M15): the fit from lagged moments equals the fit on windows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aeris.operators import forecast, ordered

FEATURES, LABELS = ["u", "v"], ["y", "z"]


def _rows(seed, sizes=(23, 3, 9), gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for g, size in enumerate(sizes):
        for i in range(size):
            u, v, y, z = (float(x) for x in 50 + 3 * rng.standard_normal(4))
            if gaps:
                u, y, z = (None if rng.random() < 0.2 else c for c in (u, y, z))
            rows.append((g, i, u, v, y, z))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g int, t int, u double, v double, y double, z double")


def _windows(rows, length, label):
    """Every sample written out, the day before first: (cells, label)."""
    x, y = [], []
    for g in sorted({r[0] for r in rows}):
        mine = sorted(r[1:] for r in rows if r[0] == g)
        for t in range(length, len(mine)):
            if mine[t][label] is not None:
                x.append([c or 0.0 for a in range(1, length + 1) for c in mine[t - a][1:3]])
                y.append(mine[t][label])
    return np.array(x), np.array(y)


@pytest.mark.parametrize("seed,length,block", [(1, 3, 4), (2, 5, 64), (3, 1, 5), (4, 4, 7)])
def test_moments_equal_windows_written_out(spark, seed, length, block):
    rows = _rows(seed)
    found = forecast.window_moments(_frame(spark, rows), FEATURES, LABELS, length, "t", ["g"], block)
    for column, label in ((3, "y"), (4, "z")):
        x, y = _windows(rows, length, column)
        got = found[label]
        assert got.n == len(y)
        both = np.column_stack([x, y])
        mean = got.s / got.n
        np.testing.assert_allclose(mean + got.centre, both.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(got.m / got.n - np.outer(mean, mean), np.cov(both.T, bias=True).reshape(len(both.T), -1),
                                   rtol=1e-9, atol=1e-9)


def test_fit_equals_the_library_on_flattened_windows(spark):
    df = _frame(spark, _rows(5, (40, 30), gaps=False))
    models = forecast.fit_sequence_models(df, FEATURES, LABELS, 4, "t", ["g"], reg=0.1, block_rows=16)
    got = forecast.predict_sequences(models, df, "t", ["g"], keep=("g", "t"), block_rows=16)
    seq = ordered.sequence_windows(df, FEATURES, 4, "t", partition_by=["g"])
    data = seq.withColumn("cells", array_to_vector(F.flatten("x")))
    for label in LABELS:
        fit = LinearRegression(featuresCol="cells", labelCol=label, regParam=0.1, elasticNetParam=0.0).fit(data)
        want = {(r["g"], r["t"]): r["prediction"] for r in fit.transform(data).collect()}
        have = {(r["g"], r["t"]): r[f"pred_{label}"] for r in got.collect()}
        assert have.keys() == want.keys() and len(have) == 62
        for k in want:
            assert have[k] == pytest.approx(want[k], abs=1e-6)


def test_constant_cells_and_missing_samples(spark):
    flat = _frame(spark, [(0, i, 1.0, float(i % 3), float(i), 2.0) for i in range(12)])
    models = forecast.fit_sequence_models(flat, FEATURES, LABELS, 2, "t", ["g"])
    assert (models["y"].coef[:, 0] == 0).all()
    assert (models["z"].coef == 0).all() and models["z"].intercept == pytest.approx(2.0)
    short = _frame(spark, [(0, i, 1.0, 2.0, 3.0, None) for i in range(2)])
    with pytest.raises(ValueError, match="no window"):
        forecast.fit_sequence_models(short, FEATURES, LABELS, 2, "t", ["g"])
    empty = short.where("false")
    assert forecast.predict_sequences(models, empty, "t", ["g"], keep=("t",)).count() == 0
    assert forecast.predict_sequences(models, short, "t", ["g"], keep=("t",)).count() == 0
