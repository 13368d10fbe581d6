"""P2 blocked windows equal a plain in-memory computation."""

import numpy as np
import pandas as pd
import pytest

from aeris.operators import ordered


def _frame(seed, n, groups):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n).round(3)
    v[rng.random(n) < 0.3] = np.nan
    return pd.DataFrame({"g": rng.integers(0, groups, n), "k": rng.permutation(n), "v": v})


@pytest.mark.parametrize("seed,n,groups,block", [(0, 40, 1, 3), (1, 57, 3, 5), (2, 90, 2, 7), (3, 25, 4, 1)])
def test_blocked_ops_equal_plain(spark, seed, n, groups, block):
    pdf = _frame(seed, n, groups)
    df = spark.createDataFrame(pdf.astype({"g": "int64", "k": "int64"}).replace({np.nan: None}),
                               "g long, k long, v double")
    expect = pdf.sort_values(["g", "k"]).reset_index(drop=True)
    grp = expect.groupby("g")["v"]
    want_ff = grp.ffill()
    want_bf = grp.bfill()
    want_roll = grp.transform(lambda s: s.rolling(3).mean().bfill())

    def got(out, col):
        rows = out.select("g", "k", col).toPandas().sort_values(["g", "k"]).reset_index(drop=True)
        return rows[col].astype(float)

    ff = ordered.forward_fill(df, "v", "k", partition_by=["g"], block_rows=block)
    bf = ordered.back_fill(df, "v", "k", partition_by=["g"], block_rows=block)
    roll = ordered.rolling_mean(df, "v", 3, "k", partition_by=["g"], block_rows=block)
    pd.testing.assert_series_equal(got(ff, "v"), want_ff.astype(float), check_names=False)
    pd.testing.assert_series_equal(got(bf, "v"), want_bf.astype(float), check_names=False)
    pd.testing.assert_series_equal(got(roll, "v_roll"), want_roll.astype(float), check_names=False,
                                   atol=1e-12)


@pytest.mark.parametrize("seed,length,block", [(5, 4, 3), (6, 6, 2)])
def test_sequence_windows_equal_plain(spark, seed, length, block):
    pdf = _frame(seed, 30, 2)
    df = spark.createDataFrame(pdf.astype({"g": "int64", "k": "int64"}).replace({np.nan: None}),
                               "g long, k long, v double")
    seq = ordered.sequence_windows(df, ["v"], length, "k", partition_by=["g"], block_rows=block)
    got = {(r["g"], r["k"]): [x[0] for x in r["x"]] for r in seq.collect()}
    want = {}
    for g, part in pdf.sort_values(["g", "k"]).groupby("g"):
        vals, keys = part["v"].tolist(), part["k"].tolist()
        for i in range(length, len(vals)):
            want[(g, keys[i])] = vals[i - length:i]
    assert set(got) == set(want)
    for key, xs in want.items():
        assert [None if (x is None or (isinstance(x, float) and np.isnan(x))) else x for x in xs] == \
            [None if y is None else y for y in got[key]]
