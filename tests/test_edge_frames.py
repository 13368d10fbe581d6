"""Hand-made edge frames (FIXTURES.md section 3)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from aeris.functions import advisory, calendar as cal, labels
from aeris.operators import clean, metrics, ordered, scale, split, stats
from aeris.sources import ingest


def test_wall_clock_date_of_offset_timestamp(spark):
    df = spark.createDataFrame([("2024-01-01 00:30:00+01:00",)], "s string")
    assert df.select(cal.wall_clock_date("s")).first()[0] == dt.date(2024, 1, 1)


def test_unparseable_values_become_null(spark):
    from aeris.functions.coerce import to_double_or_null, to_timestamp_or_null
    df = spark.createDataFrame([("x", "not a date"), ("1.5", "2024-02-29 10:00:00")], "n string, t string")
    rows = df.select(to_double_or_null("n").alias("n"), to_timestamp_or_null("t").alias("t")).collect()
    assert rows[0]["n"] is None and rows[0]["t"] is None
    assert rows[1]["n"] == 1.5 and rows[1]["t"] is not None


def test_leap_year_day_of_year_and_fourier(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 12, 31),)], "d date")
    rows = df.select(cal.day_of_year("d").alias("doy"), *cal.fourier_terms(cal.day_of_year("d"))).collect()
    assert [r["doy"] for r in rows] == [60, 366]
    assert rows[1]["sin_1"] == pytest.approx(math.sin(2 * math.pi * 366 / 365))


@pytest.mark.parametrize("day,expected", [
    (dt.date(1999, 4, 30), True),   # Queen's Day
    (dt.date(2013, 4, 30), True),
    (dt.date(2014, 4, 26), True),   # King's Day moved from Sunday 27 April
    (dt.date(2014, 4, 27), False),
    (dt.date(2023, 4, 27), True),
    (dt.date(2025, 5, 5), True),    # Liberation Day, divisible by 5
    (dt.date(2024, 5, 5), False),
    (dt.date(2024, 3, 31), True),   # Easter Sunday
    (dt.date(2024, 4, 1), True),    # Easter Monday
    (dt.date(2024, 5, 9), True),    # Ascension
    (dt.date(2024, 5, 20), True),   # Whit Monday
    (dt.date(2024, 12, 26), True),
    (dt.date(2024, 7, 1), False),
])
def test_holiday_rules(spark, day, expected):
    df = spark.createDataFrame([(day,)], "date date")
    assert cal.with_holiday_flag(df).first()["holiday"] is expected


def test_holiday_join_variant_agrees(spark):
    days = spark.range(0, 3 * 366).select(F.date_add(F.lit(dt.date(2012, 1, 1)), F.col("id").cast("int")).alias("date"))
    a = cal.with_holiday_flag(days).where("holiday").select("date")
    b = cal.with_holiday_flag_join(days).where("holiday").select("date")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_month_weekday_numbers(spark):
    df = spark.createDataFrame([("February", "Sunday"), ("Nope", "Monday")], "m string, w string")
    rows = df.select(cal.month_number("m"), cal.weekday_number("w")).collect()
    assert tuple(rows[0]) == (2, 7) and tuple(rows[1]) == (None, 1)


def test_log1p_guard(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,), (0.0,)], "x double")
    assert [r[0] for r in df.select(labels.safe_log1p("x")).collect()] == [None, None, 0.0]


def test_labels_null_handling(spark):
    df = spark.createDataFrame([(None, None, dt.date(2024, 6, 1)), (25.0, 30.0, dt.date(2024, 6, 1)),
                                (5.0, 90.0, dt.date(2024, 6, 1))], "no2 double, o3 double, d date")
    rows = df.select(labels.warm_high_o3("o3", "d").alias("w"), labels.inverse_no2_o3("no2", "o3").alias("i")).collect()
    assert [(r["w"], r["i"]) for r in rows] == [(False, 0), (False, 1), (True, 1)]


@pytest.mark.parametrize("v,band", [(0, "Good"), (50, "Good"), (51, "Moderate"), (300, "Very Unhealthy"),
                                    (301, "Hazardous"), (500, "Hazardous"), (501, None), (None, None)])
def test_aqi_band_edges(spark, v, band):
    df = spark.createDataFrame([(v,)], "v int")
    assert df.select(advisory.aqi_band("v")).first()[0] == band


def test_health_advice(spark):
    df = spark.createDataFrame([(25.0, 70.0), (1.0, 1.0)], "a double, b double")
    rows = df.select(advisory.health_advice("a", "b")).collect()
    assert rows[0][0] == [advisory.NO2_ADVICE, advisory.O3_ADVICE]
    assert rows[1][0] == [advisory.SAFE_ADVICE]


def test_constant_column_rules(spark):
    df = spark.createDataFrame([(1, 5.0, float(i)) for i in range(10)], "k int, c double, x double")
    mm = scale.minmax_by_split(df.withColumn("split", F.lit("train")), ["c"], "split")
    assert {r["c"] for r in mm.collect()} == {0.0}
    z = scale.zscore(df, ["c"])
    assert {r["c"] for r in z.collect()} == {0.0}
    sk = stats.skew_table(df, ["c"]).first()
    assert sk["skew"] == 0.0
    corr = stats.corr_long(df, ["c", "x"], fill_zero=True).where("col_a = 'c' AND col_b = 'x'").first()
    assert corr["r"] is None


def test_adjusted_skewness_matches_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 40.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(stats.adjusted_skewness("x")).first()[0]
    assert got == pytest.approx(pd.Series(vals).skew())


def test_rolling_guard_and_backfill(spark):
    for n in (6, 7, 8):
        df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(n)],
                                   "date date, v double")
        out = ordered.rolling_mean(df, "v", 7, "date", block_rows=3).orderBy("date").collect()
        vals = [r["v_roll"] for r in out]
        if n < 7:
            assert vals == [None] * n
        else:
            assert vals[0] == 3.0 and vals[6] == 3.0 and vals[-1] == sum(range(n - 7, n)) / 7


def test_sequence_windows_counts(spark):
    for n, expected in ((14, 0), (15, 1), (20, 6)):
        df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(n)],
                                   "date date, v double")
        seq = ordered.sequence_windows(df, ["v"], 14, "date", block_rows=4)
        rows = seq.orderBy("date").collect()
        assert len(rows) == expected
        if rows:
            assert [x[0] for x in rows[0]["x"]] == [float(i) for i in range(14)]


def test_fills_across_blocks(spark):
    vals = [None, 1.0, None, None, None, None, 2.0, None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v double")
    ff = ordered.forward_fill(df, "v", "k", block_rows=2).orderBy("k").collect()
    bf = ordered.back_fill(df, "v", "k", block_rows=2).orderBy("k").collect()
    assert [r["v"] for r in ff] == [None, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0]
    assert [r["v"] for r in bf] == [1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 2.0, None, None]


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = ordered.row_index(df, "k", partitions=7).collect()
    assert sorted(r["row_id"] for r in out) == list(range(1000))
    assert all(r["row_id"] == r["k"] for r in out)


def test_split_sizes_n100(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    s = split.chronological_split(df, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 70, "val": 15, "test": 15}
    g = split.resplit_with_gap(df, "k")
    sizes = {r["split"]: r["count"] for r in g.groupBy("split").count().collect()}
    assert sizes == {"train": 60, "val": 18, "test": 18, "gap": 4}
    assert g.where("unseen").count() == 5


def test_null_safe_duplicate_count(spark):
    rows = [("train", 1, None), ("train", 1, None), ("val", 1, None), ("val", 2, 3), ("test", 2, 3)]
    df = spark.createDataFrame(rows, "split string, a int, b int")
    got = {r["pair"]: r["n_dup"] for r in split.duplicate_rows_between(df, ["a", "b"]).collect()}
    assert got == {"train_val": 2, "train_test": 0, "val_test": 1}


def test_keep_first_old_wins(spark):
    old = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "date date, temp double")
    new = spark.createDataFrame([(dt.date(2024, 1, 1), 9.0, 3.0), (dt.date(2024, 1, 2), 2.0, 4.0)],
                                "date date, temp double, wind double")
    u = ingest.union_sources(old, new)
    kept = ingest.keep_first(u, "date", ["source_rank"], drop_cols=["source_rank"]).orderBy("date").collect()
    assert kept[0]["temp"] == 1.0 and kept[0]["wind"] is None and kept[1]["temp"] == 2.0


def test_high_water_append(spark):
    ex = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id int, ts timestamp_ntz")
    batch = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "id int, ts timestamp_ntz")
    out = ingest.append_after_mark(ex, batch).collect()
    assert sorted((r["id"], r["is_new"]) for r in out) == [(1, False), (2, True)]
    empty = ingest.append_after_mark(ex, ex).collect()
    assert [(r["id"], r["is_new"]) for r in empty] == [(1, False)]


def test_r2_constant_target_rule(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(df, ["y"], ["p"]).first()["r2"] == 1.0
    df2 = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(df2, ["y"], ["p"]).first()["r2"] == 0.0


def test_missing_columns_error(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="Missing columns"):
        clean.reorder_columns(df, ["a", "b"])


def test_ridge_matches_closed_form(spark):
    import numpy as np
    from aeris.operators import linear
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)], "a double, b double, c double, y double")
    m = linear.fit_linear(df, ["a", "b", "c"], ["y"], alpha=1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(m.coef[:, 0], beta, atol=1e-8)
    assert m.intercept[0] == pytest.approx(y.mean() - x.mean(0) @ beta)


def test_cv_by_subtraction_equals_refit(spark):
    import numpy as np
    from aeris.operators import linear
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(2 * a - b + rng.normal(scale=0.01)), int(i % 3))
            for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    _, models = linear.cross_validate(df, ["a", "b"], ["y"], "fold", 0.5)
    direct = linear.fit_linear(df.where("fold != 1"), ["a", "b"], ["y"], alpha=0.5)
    assert np.allclose(models[1].coef, direct.coef) and np.allclose(models[1].intercept, direct.intercept)


def test_exact_quantiles_with_heavy_ties(spark):
    import numpy as np
    vals = [5.0] * 100 + [float(i) for i in range(200)]  # one value holds a third of the rows
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = stats.exact_quantiles(df, ["x"], (0.25, 0.5, 0.75)).first()
    assert [got["q0"], got["q1"], got["q2"]] == pytest.approx(list(np.quantile(vals, [0.25, 0.5, 0.75])))
    d = stats.describe(df, ["x"], method="sort").first()
    assert d["count"] == 300 and d["p50"] == pytest.approx(float(np.median(vals)))


def test_invariants_scaled_range_and_fold_sizes(spark):
    from tests.conftest import SMOKE_DIR
    from aeris.plans import pipeline as pl
    f = pl.merged_daily(spark, SMOKE_DIR)
    n = f.count()
    sp = split.chronological_split(f, "date")
    cols = ["avg_no2", "avg_o3", "temp", "n"]
    scaled = scale.minmax_by_split(sp, cols, "split")
    bounds = scaled.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    for c in cols:
        assert bounds[f"lo_{c}"] is None or bounds[f"lo_{c}"] >= 0.0
        assert bounds[f"hi_{c}"] is None or bounds[f"hi_{c}"] <= 1.0
    folds = split.with_folds(f, "date", 5, 42).groupBy("fold").count().collect()
    assert sum(r["count"] for r in folds) == n and {r["fold"] for r in folds} <= set(range(5))
    ids = sorted(r[0] for r in ordered.row_index(f, "date").select("row_id").collect())
    assert ids == list(range(n))


def test_large_mean_columns_keep_their_digits(spark):
    import numpy as np
    from aeris.operators import linear
    rng = np.random.default_rng(3)
    a = 1.7e9 + rng.normal(size=400)
    b = a + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    r = {(x["col_a"], x["col_b"]): x["r"] for x in stats.corr_long(df, ["a", "b"], fill_zero=True).collect()}
    assert r["a", "b"] == pytest.approx(df.corr("a", "b"), abs=1e-6)
    assert r["a", "a"] == pytest.approx(1.0) and r["b", "b"] == pytest.approx(1.0)
    m = linear.fit_linear(df, ["a"], ["b"])
    slope = np.cov(a, b)[0, 1] / np.var(a, ddof=1)
    assert m.coef[0, 0] == pytest.approx(slope, abs=1e-6)


def test_a_matrix_plans_its_input_twice(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    values = pd.DataFrame(rng.normal(size=(60, 10)) + 1e3, columns=[f"c{i}" for i in range(10)])
    values = values.mask(rng.random(values.shape) < 0.2)
    cells = [tuple(None if math.isnan(v) else v for v in row) for row in values.itertuples(index=False)]
    df = spark.createDataFrame(cells, ", ".join(f"{c} double" for c in values))
    for fill_zero in (False, True):
        corr = stats.corr_long(df, list(values), fill_zero)
        # once for the means, once for the moments, however many columns there are
        assert corr._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
        expected = (values.fillna(0.0) if fill_zero else values).corr()
        rows = corr.collect()
        assert len(rows) == 100
        for r in rows:
            assert r["r"] == pytest.approx(expected.loc[r["col_a"], r["col_b"]], abs=1e-9)


def test_hot_value_is_one_row_of_the_quantile_sort(spark):
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    counted = df.groupBy("x").count()
    placed = ordered.running_weight(counted, ["x"], "count", "upto")
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) + 100
    assert placed.agg(F.max("upto")).first()[0] == 30000


def test_fill_with_several_rows_per_date(spark):
    rows = [(dt.date(2024, 1, 1 + i // 3), i, None if i % 4 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "date date, k int, v double")
    out = ordered.forward_fill(df, "v", ["date", "k"], block_rows=4).orderBy("k").collect()
    assert [r["v"] for r in out] == [float(i - i % 4) for i in range(30)]


def test_append_to_an_empty_target(spark):
    batch = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, None)], "id int, ts timestamp_ntz")
    out = ingest.append_after_mark(batch.where(F.lit(False)), batch).collect()
    assert sorted((r["id"], r["is_new"]) for r in out) == [(1, True), (2, True)]


def test_leak_report_finds_a_planted_copy(spark):
    rows = [("train", dt.date(2024, 1, i + 1), float(i), 0.5) for i in range(6)]
    rows += [("val", dt.date(2024, 2, i + 1), float(10 + i), 0.5) for i in range(3)]
    rows += [("test", dt.date(2024, 3, 1), 2.0, 0.5), ("test", dt.date(2024, 3, 2), 30.0, 0.5)]
    df = spark.createDataFrame(rows, "split string, date date, x double, y double")
    got = {(r["check"], r["pair"]): r["value"] for r in split.leakage_report(
        df, ["x", "y"], features=["x", "y"], targets=["y"]).collect()}
    assert got["duplicate_rows", "train_test"] == 1 and got["duplicate_rows", "train_val"] == 0
    assert got["date_overlap", "train_val"] == 0 and got["target_in_features", "all"] == 1


def test_empty_part_of_a_resplit_raises(spark):
    with pytest.raises(Exception, match="Validation or test set is empty"):
        split.resplit_with_gap(spark.range(0, 2).withColumnRenamed("id", "k"), "k").collect()


def _line(spark, n, noise, sign, seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    return spark.createDataFrame([(float(a), float(sign * a + rng.normal(scale=noise)), int(i % 3))
                                  for i, a in enumerate(x)], "x double, y double, fold int")


@pytest.mark.parametrize("penalty", ["ridge", "lasso"])
def test_overfit_search_ends_and_says_so(spark, penalty):
    from aeris.operators import linear
    good = linear.overfit_search(_line(spark, 90, 0.1, 1, 5), _line(spark, 60, 0.1, 1, 6), ["x"], ["y"], penalty=penalty,
                                 alpha=0.001)
    assert good[-1][4] is True
    bad = linear.overfit_search(_line(spark, 90, 0.1, 1, 5), _line(spark, 60, 0.1, -1, 6), ["x"], ["y"], gap=1e-9,
                                penalty=penalty, alpha=0.001)
    assert bad[-1][4] is False and len(bad) > 3
    assert len(linear.overfit_search(_line(spark, 90, 0.1, 1, 5), _line(spark, 60, 0.1, -1, 6), ["x"], ["y"], alpha=0.0)) == 1


def test_overfit_search_goes_on_however_many_rows_there_are(spark):
    """The first doublings of alpha move next to nothing on a large table."""
    from aeris.operators import linear
    for n in (300, 30_000):
        found = linear.overfit_search(_line(spark, n, 0.05, 1, 1), _line(spark, n // 2, 0.8, 1, 2), ["x"], ["y"], gap=0.1)
        assert found[-1][4] is True and found[-1][1] >= n / 8
        assert all(abs(cv - test) > 0.1 for _, _, cv, test, _ in found[:-1])


def test_lasso_meets_its_optimality_conditions(spark):
    import numpy as np
    from aeris.operators import linear
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 5)) + 10
    x[:, 4] = 3.0  # constant
    x[:, 3] = x[:, 0] + rng.normal(scale=0.01, size=150)  # nearly the same as another
    y = np.stack([x @ [1.0, -2, 0, 0, 5] + rng.normal(size=150), x[:, 1] * 0.05 + rng.normal(size=150)], axis=1)
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([tuple(map(float, [*r, *t])) for r, t in zip(x, y)], [*names, "y", "z"])
    for alpha in (0.01, 0.3, 100.0):
        model = linear.fit_lasso(df, names, ["y", "z"], alpha)
        for r in linear.lasso_conditions(df, model).collect():
            wanted = alpha * np.sign(r["coef"])
            assert abs(r["slope"] - wanted) < 1e-8 if r["coef"] else abs(r["slope"]) <= alpha + 1e-8
    assert not linear.fit_lasso(df, names, ["y", "z"], 100.0).coef.any()


def test_folds_are_a_bijection_of_equal_parts(spark):
    for n in (0, 1, 2, 6, 100, 1013):
        df = spark.range(n).withColumnRenamed("id", "k")
        place = df.withColumn("n", F.lit(n).cast("long")).select(split.shuffled_position(F.col("k"), F.col("n"), 3))
        assert sorted(r[0] for r in place.collect()) == list(range(n))
        sizes = [r["count"] for r in split.with_folds(df, "k", 5).groupBy("fold").count().collect()]
        assert sum(sizes) == n and (n < 5 or len(sizes) == 5 and max(sizes) - min(sizes) <= 1)


def test_row_index_is_lazy_and_splits_a_hot_value(spark):
    df = spark.range(0, 6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("a"),
                                     F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5).alias("b"), "id")
    out = ordered.row_index(df, ["a", "b", "id"], partitions=20)
    assert "Scan ExistingRDD" not in out._jdf.queryExecution().toString()  # nothing was written
    rows = out.orderBy("row_id").collect()
    keys = [(r["a"], r["b"] is not None, r["b"] or 0, r["id"]) for r in rows]
    assert [r["row_id"] for r in rows] == list(range(6000)) and keys == sorted(keys)
    sizes = [r["count"] for r in ordered._ranged(df, ["a", "b", "id"], 20).groupBy("_pid").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 3 * 6000 / 20


def test_overfit_scores_equal_metrics(spark):
    import numpy as np
    from aeris.operators import linear
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b), float(a - 2 * b + rng.normal()), int(i % 3)) for i, (a, b) in
            enumerate(rng.normal(loc=100, size=(80, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    folds, models = linear.cross_validate(df, ["a", "b"], ["y"], "fold", 1.0)
    wanted = folds.agg(F.avg("r2")).first()[0]
    found = linear.overfit_search(df, df, ["a", "b"], ["y"], alpha=1.0)[0]
    scored = models[max(models)].predict(df)
    assert found[2] == pytest.approx(wanted, abs=1e-9)
    assert found[3] == pytest.approx(metrics.regression_metrics(scored, ["y"], ["pred_y"]).first()["r2"], abs=1e-9)
