"""Query catalogue: every registered query as a Spark plan plus its DuckDB oracle.

Each query reads the driver tables of ``sf_dir`` (or plans Spark derives from
them) in full. Doubles are rounded to 6 decimals on both sides so the oracle's
value hash is insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeris.functions import calendar as cal
from aeris.functions import labels
from aeris.operators import clean, daily, ordered
from aeris.plans import model_sql as ms
from aeris.plans import pipeline as pl
from aeris.plans import sql_fixtures as q
from aeris.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rd(c) -> "F.Column":
    """Half-up rounding to 6 decimals by the same arithmetic the oracle uses."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000000.0 + 0.5).cast("double") / 1000000.0


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals."""
    return df.select(*[rd(f.name).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


MERGED_DOUBLES = ["avg_no", "avg_no2", "avg_o3", "avg_nox", "temp", "humidity", "windspeed"]
LABEL_COLS = ["month", "holiday", "weekday", "high_o3_warm_months", "inverse_no2_o3",
              "relative_difference", "day_of_year", "sin_1", "cos_1", "sin_2", "cos_2"]

# --- L1 / L2: the flagship ----------------------------------------------------


@register("merged_labelled", q.with_(q.LABELLED, "SELECT date, " + q.rnd(MERGED_DOUBLES) + ", n, month, holiday, "
          "weekday, high_o3_warm_months, inverse_no2_o3, " + q.rnd(["relative_difference"]) +
          ", day_of_year, " + q.rnd(["sin_1", "cos_1", "sin_2", "cos_2"]) + " FROM l"))
def merged_labelled(spark, sf_dir):
    return r6(pl.labelled_daily(spark, sf_dir))


# --- scans, filters, imputation -----------------------------------------------

@register("station_filter", q.with_([q.R, q.K], "SELECT station, pollutant, " +
          q.rd("concentration") + " AS concentration, ts FROM k"))
def station_filter(spark, sf_dir):
    return r6(pl.kept_readings(spark, sf_dir))


@register("mean_impute", q.with_([q.R, q.K, q.IMP], "SELECT station, pollutant, " +
          q.rd("concentration") + " AS concentration, ts FROM imp"))
def mean_impute(spark, sf_dir):
    return r6(clean.mean_impute(pl.kept_readings(spark, sf_dir), "concentration"))


@register("coerce_types", q.with_([q.R], """SELECT station,
  try_cast(CAST(concentration AS VARCHAR) AS DOUBLE) AS concentration,
  try_cast(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts,
  try_cast(pollutant AS DOUBLE) AS pollutant_as_number FROM r"""))
def coerce_types(spark, sf_dir):
    """Strings parsed leniently: numbers and timestamps, bad values -> NULL."""
    from aeris.functions.coerce import to_double_or_null, to_timestamp_or_null
    r = tables.readings(spark, sf_dir)
    return r.select("station",
                    to_double_or_null(F.col("concentration").cast("string")).alias("concentration"),
                    to_timestamp_or_null(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
                    .cast("timestamp_ntz").alias("ts"),
                    to_double_or_null("pollutant").alias("pollutant_as_number"))


@register("complete_cases", q.with_(q.BASE, "SELECT date, " + q.rnd(MERGED_DOUBLES) +
          ", n FROM m WHERE avg_no IS NOT NULL AND avg_no2 IS NOT NULL AND avg_o3 IS NOT NULL "
          "AND avg_nox IS NOT NULL AND temp IS NOT NULL"))
def complete_cases(spark, sf_dir):
    m = pl.merged_unfilled(spark, sf_dir)
    return r6(clean.complete_cases(m, ["avg_no", "avg_no2", "avg_o3", "avg_nox", "temp"]))


# --- daily rollup, pivot, merge -------------------------------------------------

@register("daily_pivot_avg", q.with_([q.R, q.K, q.IMP, q.D], "SELECT date, " +
          q.rnd(["avg_no", "avg_no2", "avg_o3", "avg_nox"]) + " FROM d"))
def daily_pivot_avg(spark, sf_dir):
    return r6(pl.daily_pollutants(spark, sf_dir))


@register("pivot_all", q.with_([q.EV], "SELECT date_trunc('hour', ts) AS hour, " + ", ".join(
    q.rd(f"avg(CASE WHEN pollutant = '{p}' THEN concentration END)") + f" AS {p}"
    for p in ["click", "error", "purchase", "signup", "view"])
    + " FROM ev GROUP BY 1"))
def pivot_all(spark, sf_dir):
    """Mean of every pollutant per hour; the pivot finds the pollutants itself."""
    # date_trunc yields a zoned timestamp: cast back to the NTZ wall clock
    ev = tables.event_readings(spark, sf_dir).withColumn(
        "hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return r6(daily.pivot_mean(ev, "hour", "pollutant", "concentration"))


@register("outer_merge", q.with_(q.BASE, "SELECT date, " + q.rnd(MERGED_DOUBLES) + ", n FROM m"))
def outer_merge(spark, sf_dir):
    return r6(pl.merged_unfilled(spark, sf_dir))


@register("coverage_gap", q.with_([q.R, q.K, q.IMP, q.D, q.W],
                                  "SELECT date FROM d WHERE date NOT IN (SELECT date FROM w)"))
def coverage_gap(spark, sf_dir):
    return clean.coverage_gap(pl.daily_pollutants(spark, sf_dir), tables.weather(spark, sf_dir))


# --- ordered --------------------------------------------------------------------

@register("forward_fill", q.with_(q.BASE, "SELECT date, " + q.rnd(MERGED_DOUBLES) + ", n FROM f"))
def forward_fill(spark, sf_dir):
    return r6(pl.merged_daily(spark, sf_dir))


_BF = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


@register("back_fill", q.with_(q.BASE, "SELECT date, " + ", ".join(
    q.rd(f"first_value({c} IGNORE NULLS) OVER (ORDER BY date {_BF})") + f" AS {c}" for c in MERGED_DOUBLES)
    + f", first_value(n IGNORE NULLS) OVER (ORDER BY date {_BF}) AS n FROM m"))
def back_fill(spark, sf_dir):
    m = pl.merged_unfilled(spark, sf_dir)
    return r6(ordered.back_fill(m, pl.POLLUTANT_COLS + pl.WEATHER_COLS, "date", one_row_per_date=True))


@register("row_index", q.with_(q.BASE + [q.S], "SELECT date, row_id FROM s"))
def row_index(spark, sf_dir):
    return ordered.row_index(pl.merged_daily(spark, sf_dir), "date").select("date", ordered.ROW_ID)


@register("current_row", q.with_(q.BASE, "SELECT date, " + q.rnd(MERGED_DOUBLES) +
                                 ", n FROM f ORDER BY date DESC LIMIT 1"))
def current_row(spark, sf_dir):
    return r6(ordered.current_row(pl.merged_daily(spark, sf_dir), "date"))


@register("next_k", q.with_(q.BASE, "SELECT date, " + q.rnd(["avg_no2", "avg_o3"]) +
                            " FROM f ORDER BY date LIMIT 3"))
def next_k(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir).select("date", "avg_no2", "avg_o3")
    return r6(ordered.first_k(f, 3, "date"))


# --- labels ---------------------------------------------------------------------

@register("month_weekday", q.with_(q.BASE, """SELECT date, strftime(date, '%B') AS month,
  strftime(date, '%A') AS weekday, CAST(month(date) AS INTEGER) AS month_number,
  CAST(isodow(date) AS INTEGER) AS weekday_number FROM f"""))
def month_weekday(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir).select("date")
    f = f.select("date", cal.month_name("date").alias("month"), cal.weekday_name("date").alias("weekday"))
    return f.select("*", cal.month_number("month").alias("month_number"),
                    cal.weekday_number("weekday").alias("weekday_number"))


@register("holiday_flag", q.with_(q.BASE + [q.YRS, q.EAS, q.HOL],
                                  "SELECT f.date, (hol.hd IS NOT NULL) AS holiday FROM f "
                                  "LEFT JOIN hol ON f.date = hol.hd"))
def holiday_flag(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir).select("date")
    return cal.with_holiday_flag(f, "date", "holiday")


@register("warm_flag", q.with_(q.LABELLED, "SELECT date, high_o3_warm_months FROM l"))
def warm_flag(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    return f.select("date", labels.warm_high_o3("avg_o3", "date").alias("high_o3_warm_months"))


@register("inverse_flag", q.with_(q.LABELLED, "SELECT date, inverse_no2_o3 FROM l"))
def inverse_flag(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    return f.select("date", labels.inverse_no2_o3("avg_no2", "avg_o3").alias("inverse_no2_o3"))


@register("rel_diff", q.with_(q.LABELLED, "SELECT date, " + q.rnd(["relative_difference"]) + " FROM l"))
def rel_diff(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    return r6(f.select("date", labels.relative_difference("avg_no2", "avg_o3").alias("relative_difference")))


@register("fourier", q.with_(q.LABELLED, "SELECT date, day_of_year, " +
                             q.rnd(["sin_1", "cos_1", "sin_2", "cos_2"]) + " FROM l"))
def fourier(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    doy = cal.day_of_year("date")
    return r6(f.select("date", doy.alias("day_of_year"), *cal.fourier_terms(doy)))


@register("bool_to_int", q.with_(q.LABELLED, """SELECT date,
  CAST(month(date) AS INTEGER) AS month, CAST(holiday AS INTEGER) AS holiday,
  CAST(isodow(date) AS INTEGER) AS weekday,
  CAST(high_o3_warm_months AS INTEGER) AS high_o3_warm_months, inverse_no2_o3 FROM l"""))
def bool_to_int(spark, sf_dir):
    lab = pl.encoded(pl.labelled_daily(spark, sf_dir))
    return lab.select("date", "month", "holiday", "weekday", "high_o3_warm_months", "inverse_no2_o3")


# --- statistics -----------------------------------------------------------------
from aeris.operators import scale, split, stats  # noqa: E402

FILLED_NUMERIC = MERGED_DOUBLES + ["n"]
ENCODED_NUMERIC = FILLED_NUMERIC + ["month", "holiday", "weekday", "high_o3_warm_months",
                                    "inverse_no2_o3", "relative_difference", "day_of_year",
                                    "sin_1", "cos_1", "sin_2", "cos_2"]


def _encoded(spark, sf_dir):
    return pl.encoded(pl.labelled_daily(spark, sf_dir))


def _describe_sql():
    sels = [f"""SELECT '{c}' AS column, count({c}) AS count, {q.rd(f'avg(CAST({c} AS DOUBLE))')} AS mean,
      {q.rd(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, {q.rd(f'min(CAST({c} AS DOUBLE))')} AS min,
      {q.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25,
      {q.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50,
      {q.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75,
      {q.rd(f'max(CAST({c} AS DOUBLE))')} AS max FROM f""" for c in FILLED_NUMERIC]
    return q.with_(q.BASE, q.union_all(sels))


@register("describe", _describe_sql())
def describe(spark, sf_dir):
    # one row per day: the bounded in-memory exact percentile is fine here
    return r6(stats.describe(pl.merged_daily(spark, sf_dir), FILLED_NUMERIC, method="memory"))


@register("missing_counts", q.with_(q.BASE, q.union_all(
    [f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing FROM m"
     for c in ["date"] + FILLED_NUMERIC])))
def missing_counts(spark, sf_dir):
    return stats.missing_counts(pl.merged_unfilled(spark, sf_dir), ["date"] + FILLED_NUMERIC)


def _skew_sql_expr(c):
    return f"CASE WHEN count({c}) > 2 THEN coalesce(skewness(CAST({c} AS DOUBLE)), 0.0) END"


@register("skew_table", q.with_(q.ENCODED, q.union_all(
    [f"SELECT '{c}' AS column, {q.rd(_skew_sql_expr(c))} AS skew, "
     f"coalesce(abs({_skew_sql_expr(c)}) > 0.75, false) AS is_skewed FROM e" for c in ENCODED_NUMERIC])))
def skew_table(spark, sf_dir):
    return r6(stats.skew_table(_encoded(spark, sf_dir), ENCODED_NUMERIC))


def _log1p_sql():
    cols = []
    for c in ENCODED_NUMERIC:
        skewed = f"(SELECT coalesce(abs({_skew_sql_expr(c)}) > 0.75, false) FROM e)"
        cols.append(q.rd(f"CASE WHEN {skewed} THEN (CASE WHEN {c} > -1 THEN ln(1 + {c}) END) "
                         f"ELSE CAST({c} AS DOUBLE) END") + f" AS {c}")
    return q.with_(q.ENCODED, "SELECT date, " + ", ".join(cols) + " FROM e")


@register("log1p_skewed", _log1p_sql())
def log1p_skewed(spark, sf_dir):
    return r6(stats.log1p_skewed(_encoded(spark, sf_dir), ENCODED_NUMERIC))


def _corr_sql(cols, src, fill_zero):
    vals = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" if fill_zero
                     else f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    idx = ", ".join(f"('{c}', {i})" for i, c in enumerate(cols))
    return (f"""cv AS (SELECT date, {vals} FROM {src}),
  lg AS (UNPIVOT cv ON {', '.join(cols)} INTO NAME col VALUE v),
  ix AS (SELECT * FROM (VALUES {idx}) t(col, idx)),
  cm AS (SELECT a.col AS col_a, b.col AS col_b, CAST(ia.idx AS INTEGER) AS idx_a,
    CAST(ib.idx AS INTEGER) AS idx_b,
    covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS r
    FROM lg a JOIN lg b ON a.date = b.date JOIN ix ia ON ia.col = a.col JOIN ix ib ON ib.col = b.col
    GROUP BY a.col, b.col, ia.idx, ib.idx)""")


@register("corr_matrix", q.with_(q.ENCODED + [_corr_sql(ENCODED_NUMERIC, "e", True)],
                                 "SELECT col_a, col_b, idx_a, idx_b, " + q.rnd(["r"]) + " FROM cm"))
def corr_matrix(spark, sf_dir):
    return r6(stats.corr_long(_encoded(spark, sf_dir), ENCODED_NUMERIC, fill_zero=True))


@register("corr_lower", q.with_(q.ENCODED + [_corr_sql(ENCODED_NUMERIC, "e", True)],
                                "SELECT col_a, col_b, idx_a, idx_b, " + q.rnd(["r"]) +
                                " FROM cm WHERE idx_a > idx_b"))
def corr_lower(spark, sf_dir):
    return r6(stats.corr_lower(stats.corr_long(_encoded(spark, sf_dir), ENCODED_NUMERIC, True)))


@register("corr_pairwise", q.with_(q.ENCODED + [_corr_sql(ENCODED_NUMERIC, "e", False)],
                                   "SELECT col_a, col_b, idx_a, idx_b, " + q.rnd(["r"]) + " FROM cm"))
def corr_pairwise(spark, sf_dir):
    """Correlation over the rows complete for each pair."""
    return r6(stats.corr_long(_encoded(spark, sf_dir), ENCODED_NUMERIC, fill_zero=False))


@register("corr_top_targets", q.with_(q.ENCODED + [_corr_sql(ENCODED_NUMERIC, "e", False)], """
  SELECT feature, """ + q.rnd(["avg_no2", "avg_o3", "max_abs_r"]) + """ FROM (
    SELECT col_a AS feature, max(CASE WHEN col_b = 'avg_no2' THEN r END) AS avg_no2,
      max(CASE WHEN col_b = 'avg_o3' THEN r END) AS avg_o3 FROM cm
    WHERE col_a NOT IN ('avg_no2', 'avg_o3') GROUP BY col_a) t
  CROSS JOIN LATERAL (SELECT greatest(abs(avg_no2), abs(avg_o3)) AS max_abs_r)
  WHERE abs(avg_no2) > 0.5 OR abs(avg_o3) > 0.5"""))
def corr_top_targets(spark, sf_dir):
    c = stats.corr_long(_encoded(spark, sf_dir), ENCODED_NUMERIC, fill_zero=False)
    return r6(stats.corr_with_targets(c, pl.TARGETS, 0.5))


def _histogram_sql(table, cols):
    parts = [f"""SELECT '{c}' AS "column", CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((x - lo) / w), 19) END AS INTEGER) AS bin,
      lo, w FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL),
      (SELECT min(CAST({c} AS DOUBLE)) AS lo, (max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE))) / 20.0 AS w FROM {table})"""
             for c in cols]
    return ("SELECT \"column\", bin, " + q.rd("any_value(lo) + bin * any_value(w)") + " AS lo, "
            + q.rd("any_value(lo) + (bin + 1) * any_value(w)") + " AS hi, count(*) AS count FROM ("
            + q.union_all(parts) + ") GROUP BY \"column\", bin")


@register("histogram20", _histogram_sql("events", ["event_id", "user_id", "value"]))
def histogram20(spark, sf_dir):
    """Every numeric column of the raw table."""
    return r6(stats.histogram(tables.table(spark, sf_dir, "events")))


@register("histogram_daily", q.with_(q.ENCODED, _histogram_sql("e", FILLED_NUMERIC)))
def histogram_daily(spark, sf_dir):
    return r6(stats.histogram(_encoded(spark, sf_dir), FILLED_NUMERIC))


@register("quadrants", q.with_(q.BASE, """SELECT
  CASE WHEN avg_no2 > 50 THEN 'high_no2' ELSE 'low_no2' END || '/' ||
  CASE WHEN avg_o3 > 80 THEN 'high_o3' ELSE 'low_o3' END AS quadrant, count(*) AS n
  FROM f WHERE avg_no2 IS NOT NULL AND avg_o3 IS NOT NULL GROUP BY 1"""))
def quadrants(spark, sf_dir):
    return stats.quadrants(pl.merged_daily(spark, sf_dir))


# --- splits, leakage, folds, scaling ----------------------------------------------

@register("split_70_15_15", q.with_(q.BASE + [q.S, q.SP], "SELECT date, row_id, split FROM sp"))
def split_70_15_15(spark, sf_dir):
    return split.chronological_split(pl.merged_daily(spark, sf_dir), "date").select(
        "date", ordered.ROW_ID, "split")


@register("resplit_gap", q.with_(q.BASE + [q.S, q.RS], "SELECT date, row_id, split, unseen FROM rs"))
def resplit_gap(spark, sf_dir):
    return split.resplit_with_gap(pl.merged_daily(spark, sf_dir), "date").select(
        "date", ordered.ROW_ID, "split", "unseen")


_DUP_KEYS = ENCODED_NUMERIC
_DUP_SQL = """ex AS (SELECT e.*, s.row_id FROM e JOIN s USING (date)),
  rsx AS (SELECT ex.*, CASE WHEN row_id < t THEN 'train' WHEN row_id >= t + g AND row_id < v THEN 'val'
    WHEN row_id >= v + g THEN 'test' ELSE 'gap' END AS split FROM ex,
    (SELECT CAST(floor(count(*) * 0.6) AS BIGINT) AS t, CAST(floor(count(*) * 0.8) AS BIGINT) AS v,
            CAST(floor(count(*) * 0.02) AS BIGINT) AS g FROM f)),
  gr AS (SELECT split, {keys}, count(*) AS c,
    CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS rk
    FROM rsx WHERE split IN ('train', 'val', 'test') GROUP BY ALL),
  dp AS (SELECT a.split || '_' || b.split AS pair, sum(a.c * b.c) AS n_dup FROM gr a JOIN gr b
    ON a.rk < b.rk AND {same} GROUP BY 1),
  dups AS (SELECT p.pair, CAST(coalesce(dp.n_dup, 0) AS BIGINT) AS n_dup
    FROM (VALUES ('train_val'), ('train_test'), ('val_test')) p(pair) LEFT JOIN dp USING (pair))"""


def _dup_sql(keys):
    return _DUP_SQL.format(keys=", ".join(keys), same=" AND ".join(
        f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys))


def _resplit_encoded(spark, sf_dir):
    return split.resplit_with_gap(_encoded(spark, sf_dir), "date")


@register("dup_rows_between", q.with_(q.ENCODED + [q.S, _dup_sql(["month", "weekday", "holiday", "inverse_no2_o3"])],
                                      "SELECT pair, n_dup FROM dups"))
def dup_rows_between(spark, sf_dir):
    """Rows that agree on four calendar and label columns: such rows exist."""
    return split.duplicate_rows_between(_resplit_encoded(spark, sf_dir),
                                        ["month", "weekday", "holiday", "inverse_no2_o3"])


@register("leak_report", q.with_(q.ENCODED + [q.S, _dup_sql(_DUP_KEYS)], """
  SELECT 'date_overlap' AS "check", 'train_val' AS pair,
    CAST((SELECT min(date) FROM rsx WHERE split = 'val') <= (SELECT max(date) FROM rsx WHERE split = 'train') AS BIGINT) AS value
  UNION ALL SELECT 'date_overlap', 'val_test',
    CAST((SELECT min(date) FROM rsx WHERE split = 'test') <= (SELECT max(date) FROM rsx WHERE split = 'val') AS BIGINT)
  UNION ALL SELECT 'duplicate_rows', pair, n_dup FROM dups
  UNION ALL SELECT 'target_in_features', 'all', CAST(2 AS BIGINT)"""))
def leak_report(spark, sf_dir):
    """All shared columns; the raw columns still hold both targets."""
    return split.leakage_report(_resplit_encoded(spark, sf_dir), _DUP_KEYS,
                                features=ENCODED_NUMERIC, targets=pl.TARGETS)


@register("kfold_sizes", q.with_(q.BASE + [q.S] + ms.fold_ctes("s", "SELECT row_id AS id FROM s", 5),
                                 "SELECT fold, count(*) AS n FROM fold_s GROUP BY fold"))
def kfold_sizes(spark, sf_dir):
    f = split.with_folds(pl.merged_daily(spark, sf_dir), "date", 5, 42)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("kfold_members", q.with_(q.BASE + [q.S] + ms.fold_ctes("s", "SELECT row_id AS id FROM s", 3, 7),
                                   "SELECT date, fold FROM s JOIN fold_s ON fold_s.id = s.row_id"))
def kfold_members(spark, sf_dir):
    """Which day is in which of three folds (seed 7)."""
    return split.with_folds(pl.merged_daily(spark, sf_dir), "date", 3, 7).select("date", "fold")


def _mm_sql():
    cols = []
    for c in FILLED_NUMERIC:
        lo, hi = f"min(CAST({c} AS DOUBLE)) OVER (PARTITION BY split)", f"max(CAST({c} AS DOUBLE)) OVER (PARTITION BY split)"
        cols.append(q.rd(f"(CAST({c} AS DOUBLE) - {lo}) / coalesce(nullif({hi} - {lo}, 0.0), 1.0)") + f" AS {c}")
    return q.with_(q.BASE + [q.S, q.SP], "SELECT date, split, " + ", ".join(cols) + " FROM sp")


@register("minmax_by_split", _mm_sql())
def minmax_by_split(spark, sf_dir):
    sp = split.chronological_split(pl.merged_daily(spark, sf_dir), "date")
    return r6(scale.minmax_by_split(sp, FILLED_NUMERIC, "split").select("date", "split", *FILLED_NUMERIC))


def _z_sql():
    cols = [q.rd(f"(CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM f)) / "
                 f"coalesce(nullif((SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM f), 0.0), 1.0)") + f" AS {c}"
            for c in FILLED_NUMERIC]
    return q.with_(q.BASE, "SELECT date, " + ", ".join(cols) + " FROM f")


@register("zscore", _z_sql())
def zscore(spark, sf_dir):
    return r6(scale.zscore(pl.merged_daily(spark, sf_dir), FILLED_NUMERIC))


# --- ingest, unions, dedup --------------------------------------------------------
from aeris.sources import ingest  # noqa: E402

# The high-water mark of the already-ingested event readings.
EVENT_MARK = "2024-01-20 00:00:00"


def _event_parts(spark, sf_dir):
    ev = tables.event_readings(spark, sf_dir)
    existing = ev.where(F.col("ts") <= F.lit(EVENT_MARK).cast("timestamp_ntz"))
    return ev, existing


@register("high_water_append", q.with_([q.EV], """
  SELECT event_id, station, pollutant, concentration, ts, true AS is_new FROM ev
    WHERE ts > (SELECT max(ts) FROM ev WHERE ts <= TIMESTAMP '""" + EVENT_MARK + """')
  UNION ALL SELECT event_id, station, pollutant, concentration, ts, false FROM ev
    WHERE ts <= TIMESTAMP '""" + EVENT_MARK + "'"))
def high_water_append(spark, sf_dir):
    """Existing = readings up to the mark; the batch re-sends everything."""
    batch, existing = _event_parts(spark, sf_dir)
    return ingest.append_after_mark(existing, batch, "ts")


@register("initial_load", q.with_([q.EV],
          "SELECT event_id, station, pollutant, concentration, ts, true AS is_new FROM ev"))
def initial_load(spark, sf_dir):
    """An empty target takes the whole batch."""
    batch = tables.event_readings(spark, sf_dir)
    return ingest.append_after_mark(batch.where(F.lit(False)), batch, "ts")


@register("delta_rows", q.with_([q.EV], """SELECT event_id, station, pollutant, concentration, ts FROM ev
  WHERE ts > (SELECT max(ts) FROM ev WHERE ts <= TIMESTAMP '""" + EVENT_MARK + "')"))
def delta_rows(spark, sf_dir):
    batch, existing = _event_parts(spark, sf_dir)
    return ingest.new_rows(batch, ingest.high_water_mark(existing, "ts"), "ts")


@register("last_date", "SELECT strftime(max(ts), '%Y-%m-%d') AS last_date FROM events")
def last_date(spark, sf_dir):
    return ingest.last_available_date(tables.table(spark, sf_dir, "events"), "ts")


# old weather: dates before the cut, without windspeed; new weather: from a month
# earlier, without humidity. The overlap month resolves keep-first (old wins).
OLD_BEFORE, NEW_FROM = "1998-01-01", "1997-12-01"
_UF_SQL = [q.W, """u AS (SELECT date, temp, humidity, CAST(NULL AS DOUBLE) AS windspeed, n, 0 AS source_rank
    FROM w WHERE date < DATE '""" + OLD_BEFORE + """'
  UNION ALL SELECT date, temp, CAST(NULL AS DOUBLE), windspeed, n, 1 FROM w WHERE date >= DATE '""" + NEW_FROM + """'),
  kf AS (SELECT date, temp, humidity, windspeed, n FROM (SELECT *, row_number() OVER
    (PARTITION BY date ORDER BY source_rank, temp, humidity, windspeed, n) AS rn FROM u) WHERE rn = 1)"""]


def _weather_union(spark, sf_dir):
    w = tables.weather(spark, sf_dir)
    old = w.where(F.col("date") < F.lit(OLD_BEFORE).cast("date")).drop("windspeed")
    new = w.where(F.col("date") >= F.lit(NEW_FROM).cast("date")).drop("humidity")
    return ingest.union_sources(old, new)


@register("dedup_first", q.with_(_UF_SQL, "SELECT date, " + q.rnd(["temp", "humidity", "windspeed"]) + ", n FROM kf"))
def dedup_first(spark, sf_dir):
    u = _weather_union(spark, sf_dir)
    kept = ingest.keep_first(u, "date", ["source_rank", "temp", "humidity", "windspeed", "n"],
                             drop_cols=["source_rank"])
    return r6(kept.select("date", "temp", "humidity", "windspeed", "n"))


@register("dedup_count", q.with_(_UF_SQL, "SELECT CAST(count(*) - count(DISTINCT date) AS BIGINT) AS duplicates FROM u"))
def dedup_count(spark, sf_dir):
    return ingest.duplicate_count(_weather_union(spark, sf_dir), "date")


@register("union_fill", q.with_(_UF_SQL, "SELECT date, " + ", ".join(
    q.rd(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date {q._FF})") + f" AS {c}"
    for c in ["temp", "humidity", "windspeed"]) + f", last_value(n IGNORE NULLS) OVER (ORDER BY date {q._FF}) AS n FROM kf"))
def union_fill(spark, sf_dir):
    u = _weather_union(spark, sf_dir)
    kept = ingest.keep_first(u, "date", ["source_rank", "temp", "humidity", "windspeed", "n"],
                             drop_cols=["source_rank"]).select("date", "temp", "humidity", "windspeed", "n")
    # one row per date after keep-first
    return r6(ordered.forward_fill(kept, ["temp", "humidity", "windspeed", "n"], "date", one_row_per_date=True))


# --- rolling and sequence windows ---------------------------------------------------

_W7 = "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW"
_ROLL_SQL = """ro AS (SELECT date, split, row_id, CASE WHEN count(avg_no2) OVER (PARTITION BY split ORDER BY row_id """ + _W7 + """) = 7
    THEN avg(avg_no2) OVER (PARTITION BY split ORDER BY row_id """ + _W7 + """) END AS no2_week,
  CASE WHEN count(avg_o3) OVER (PARTITION BY split ORDER BY row_id """ + _W7 + """) = 7
    THEN avg(avg_o3) OVER (PARTITION BY split ORDER BY row_id """ + _W7 + """) END AS o3_week FROM sp),
  rb AS (SELECT date, split, row_id,
    first_value(no2_week IGNORE NULLS) OVER (PARTITION BY split ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS no2_week,
    first_value(o3_week IGNORE NULLS) OVER (PARTITION BY split ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS o3_week FROM ro)"""


def _rolled(spark, sf_dir):
    sp = split.chronological_split(pl.merged_daily(spark, sf_dir), "date")
    r = ordered.rolling_mean(sp, ["avg_no2", "avg_o3"], 7, "date", partition_by=["split"], suffix="_week")
    return r.withColumnRenamed("avg_no2_week", "no2_week").withColumnRenamed("avg_o3_week", "o3_week")


@register("rolling_mean7", q.with_(q.BASE + [q.S, q.SP, _ROLL_SQL],
                                   "SELECT date, split, " + q.rnd(["no2_week", "o3_week"]) + " FROM rb"))
def rolling_mean7(spark, sf_dir):
    return r6(_rolled(spark, sf_dir).select("date", "split", "no2_week", "o3_week"))


SEQ_LEN = 14
SEQ_FEATURES = FILLED_NUMERIC  # numeric columns except the two label columns


@register("sequence_windows", q.with_(q.BASE + [q.S, q.SP, _ROLL_SQL], """
  SELECT date, split, n_steps, first_date, x_micro, """ + q.rnd(["y_no2", "y_o3"]) + """ FROM (
    SELECT b.date, b.split, count(*) OVER wq AS n_steps,
      min(b.date) OVER wq AS first_date,
      CAST(sum(""" + " + ".join(f"floor(coalesce(CAST(b.{c} AS DOUBLE), 0) * 1000000.0 + 0.5)"
                                for c in SEQ_FEATURES) + """) OVER wq AS BIGINT) AS x_micro,
      r.no2_week AS y_no2, r.o3_week AS y_o3
    FROM sp b JOIN rb r USING (date)
    WINDOW wq AS (PARTITION BY b.split ORDER BY b.row_id ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
  WHERE n_steps = 14"""))
def sequence_windows(spark, sf_dir):
    """Windows of 14 previous days per split; label = the day's 7-day means.
    Reported per sample: window length, first day, and the sum of all window
    cells in integer micro-units (exact, so independent of summation order)."""
    r = _rolled(spark, sf_dir)
    seq = ordered.sequence_windows(r, SEQ_FEATURES, SEQ_LEN, "date", partition_by=["split"],
                                   first_of="date")
    cells = F.aggregate(F.flatten("x"), F.lit(0).cast("bigint"),
                        lambda acc, v: acc + F.floor(F.coalesce(v, F.lit(0.0)) * 1000000.0 + 0.5))
    return r6(seq.select("date", "split", F.size("x").cast("bigint").alias("n_steps"),
                         F.col("first_date"), cells.alias("x_micro"),
                         F.col("no2_week").alias("y_no2"), F.col("o3_week").alias("y_o3")))


# --- advisory -----------------------------------------------------------------------
from aeris.functions import advisory  # noqa: E402
from aeris.operators import linear, metrics  # noqa: E402


# Fixed values, written out: the oracle must not follow an error in the library.
NO2_TEXT = "NO2 levels are above the guideline. People with respiratory conditions should take precautions."
O3_TEXT = "Ozone levels are high. Reduce outdoor activities, especially during midday hours."
SAFE_TEXT = "Pollutant levels are within safe limits. Enjoy your outdoor activities."


def _advice_sql():
    no2, o3, safe = (x.replace("'", "''") for x in (NO2_TEXT, O3_TEXT, SAFE_TEXT))
    return q.with_(q.BASE, f"""SELECT date, CASE WHEN coalesce(avg_no2 > 20, false) OR coalesce(avg_o3 > 60, false)
      THEN concat_ws(' | ', CASE WHEN avg_no2 > 20 THEN '{no2}' END, CASE WHEN avg_o3 > 60 THEN '{o3}' END)
      ELSE '{safe}' END AS advice,
      CAST(CASE WHEN coalesce(avg_no2 > 20, false) OR coalesce(avg_o3 > 60, false)
      THEN (CASE WHEN avg_no2 > 20 THEN 1 ELSE 0 END) + (CASE WHEN avg_o3 > 60 THEN 1 ELSE 0 END)
      ELSE 1 END AS INTEGER) AS n_advice FROM f""")


@register("health_advice", _advice_sql())
def health_advice(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir).select("date", advisory.health_advice("avg_no2", "avg_o3").alias("a"))
    return f.select("date", F.array_join("a", " | ").alias("advice"), F.size("a").alias("n_advice"))


AQI_TEXT = [
    (0, 50, 'Good', 'None'),
    (51, 100, 'Moderate', 'Usually sensitive individuals should consider limiting prolonged outdoor exertion.'),
    (101, 150, 'Unhealthy for Sensitive Groups', 'Children, active adults, and people with respiratory disease, such as asthma, should limit prolonged outdoor exertion.'),
    (151, 200, 'Unhealthy', 'Children, active adults, and people with respiratory disease, such as asthma, should avoid outdoor exertion; everyone else should limit prolonged outdoor exertion.'),
    (201, 300, 'Very Unhealthy', 'Children, active adults, and people with respiratory disease, such as asthma, should avoid outdoor exertion; everyone else should limit outdoor exertion.'),
    (301, 500, 'Hazardous', 'Everyone should avoid all physical activity outdoors.'),
]


def _aqi_sql():
    def case(k):
        rows = " ".join(f"WHEN ceil(avg_no2) BETWEEN {x[0]} AND {x[1]} THEN '{x[k]}'" for x in AQI_TEXT)
        return f"CASE {rows} END"
    return q.with_(q.BASE, f"""SELECT band, advisory, count(*) AS n FROM (
      SELECT {case(2)} AS band, {case(3)} AS advisory FROM f) GROUP BY band, advisory""")


@register("aqi_band", _aqi_sql())
def aqi_band(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    return (f.groupBy(advisory.aqi_band("avg_no2").alias("band"), advisory.aqi_advisory("avg_no2").alias("advisory"))
             .agg(F.count(F.lit(1)).alias("n")))


# --- models ---------------------------------------------------------------------------

@register("ols_univariate", q.with_(q.BASE, "SELECT " + ", ".join([
    q.rd("regr_slope(avg_o3, avg_no2)") + " AS slope", q.rd("regr_intercept(avg_o3, avg_no2)") + " AS intercept",
    q.rd("regr_r2(avg_o3, avg_no2)") + " AS r2", "CAST(regr_count(avg_o3, avg_no2) AS BIGINT) AS n"]) + " FROM f"))
def ols_univariate(spark, sf_dir):
    f = clean.complete_cases(pl.merged_daily(spark, sf_dir), ["avg_no2", "avg_o3"]).select("avg_no2", "avg_o3")
    model = linear.fit_linear(f, ["avg_no2"], ["avg_o3"])
    scores = metrics.regression_metrics(model.predict(f), ["avg_o3"], ["pred_avg_o3"])
    return r6(scores.select(F.lit(float(model.coef[0, 0])).alias("slope"),
                            F.lit(float(model.intercept[0])).alias("intercept"), "r2", "n"))


RIDGE_ALPHA = 1.0


@register("ridge_two_feature", q.with_(q.BASE + ["""cc AS (SELECT avg_no2 AS x1, temp AS x2, avg_o3 AS y FROM f
    WHERE avg_no2 IS NOT NULL AND temp IS NOT NULL AND avg_o3 IS NOT NULL)""",
    """st AS (SELECT count(*) * var_pop(x1) + """ + str(RIDGE_ALPHA) + """ AS a11,
      count(*) * covar_pop(x1, x2) AS a12, count(*) * var_pop(x2) + """ + str(RIDGE_ALPHA) + """ AS a22,
      count(*) * covar_pop(x1, y) AS b1, count(*) * covar_pop(x2, y) AS b2,
      avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM cc)""",
    """co AS (SELECT (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS c1,
      (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS c2, m1, m2, my FROM st)"""],
    "SELECT 'intercept' AS term, 'avg_o3' AS target, " + q.rd("my - c1 * m1 - c2 * m2") + """ AS coef FROM co
    UNION ALL SELECT 'avg_no2', 'avg_o3', """ + q.rd("c1") + """ FROM co
    UNION ALL SELECT 'temp', 'avg_o3', """ + q.rd("c2") + " FROM co"))
def ridge_two_feature(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    model = linear.fit_linear(f, ["avg_no2", "temp"], ["avg_o3"], alpha=RIDGE_ALPHA)
    return r6(model.coefficients(spark))


_SCORE = """SELECT split, {mse} AS mse, {rmse} AS rmse, {r2} AS r2, count(*) AS n FROM (
  SELECT sp.split, sp.avg_no2 AS y1, sp.avg_o3 AS y2, {p1} AS p1, {p2} AS p2 FROM sp JOIN {src} USING (date)
  WHERE sp.avg_no2 IS NOT NULL AND sp.avg_o3 IS NOT NULL AND {p1} IS NOT NULL AND {p2} IS NOT NULL) GROUP BY split"""


def _r2_sql(y, p):
    return (f"CASE WHEN count({y}) * var_pop({y}) > 0 THEN 1 - sum(({y} - {p}) * ({y} - {p})) / (count({y}) * var_pop({y})) "
            f"WHEN sum(({y} - {p}) * ({y} - {p})) = 0 THEN 1.0 ELSE 0.0 END")


def _score_sql(src, p1, p2):
    mse = "avg((y1 - p1) * (y1 - p1) + (y2 - p2) * (y2 - p2)) / 2.0"
    return _SCORE.format(mse=q.rd(mse), rmse=q.rd(f"sqrt({mse})"),
                         r2=q.rd(f"({_r2_sql('y1', 'p1')} + {_r2_sql('y2', 'p2')}) / 2.0"),
                         p1=p1, p2=p2, src=src)


def _split_daily(spark, sf_dir):
    return split.chronological_split(pl.merged_daily(spark, sf_dir), "date")


def _scored(spark, sf_dir, backfilled=True, sp=None):
    sp = _split_daily(spark, sf_dir) if sp is None else sp
    r = ordered.rolling_mean(sp, ["avg_no2", "avg_o3"], 7, "date", partition_by=["split"],
                             suffix="_week", backfill=backfilled)
    cc = clean.complete_cases(r, ["avg_no2", "avg_o3", "avg_no2_week", "avg_o3_week"])
    return metrics.regression_metrics(cc, ["avg_no2", "avg_o3"], ["avg_no2_week", "avg_o3_week"], by="split")


@register("score_metrics", q.with_(q.BASE + [q.S, q.SP, _ROLL_SQL], _score_sql("rb", "rb.no2_week", "rb.o3_week")))
def score_metrics(spark, sf_dir):
    """Seven-day mean as the forecast of each day, scored per split."""
    return r6(_scored(spark, sf_dir))


_RAW_ROLL = """rr AS (SELECT date, no2_week AS rn, o3_week AS ro FROM ro)"""


def _upsert_sql():
    long = lambda src, ver, where: (
        f"SELECT 'rolling7' AS model, split, m.metric, m.value, {ver} AS version FROM ({src}) s "
        f"CROSS JOIN LATERAL (VALUES ('mse', s.mse), ('rmse', s.rmse), ('r2', s.r2)) m(metric, value) {where}")
    old = long(_score_sql("rb", "rb.no2_week", "rb.o3_week"), 0, "")
    new = long(_score_sql("rr", "rr.rn", "rr.ro"), 1, "WHERE split = 'test'")
    return q.with_(q.BASE + [q.S, q.SP, _ROLL_SQL, _RAW_ROLL], f"""SELECT model, split, metric, value, version FROM (
      SELECT *, row_number() OVER (PARTITION BY model, split, metric ORDER BY version DESC, value) AS rn
      FROM ({old} UNION ALL {new})) WHERE rn = 1""")


def _upserted(spark, sf_dir):
    sp = _split_daily(spark, sf_dir)  # one split (and row index) for both versions
    old = metrics.to_long(_scored(spark, sf_dir, True, sp), "split", 0, "rolling7")
    new = metrics.to_long(_scored(spark, sf_dir, False, sp).where(F.col("split") == "test"), "split", 1,
                          "rolling7")
    return metrics.upsert(old, new)


@register("metrics_upsert", _upsert_sql())
def metrics_upsert(spark, sf_dir):
    """Version 0 = scores with back-filled means; version 1 re-scores test with
    complete windows only and replaces it; train and val are kept."""
    return r6(_upserted(spark, sf_dir).select("model", "split", "metric", "value", "version"))


@register("metrics_test_view", "SELECT " + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN value END) AS test_{m}" for m in metrics.METRICS) +
    " FROM (" + _upsert_sql() + ") WHERE model = 'rolling7' AND split = 'test'")
def metrics_test_view(spark, sf_dir):
    return metrics.test_view(metrics_upsert(spark, sf_dir), "rolling7")


# --- streaming ------------------------------------------------------------------------
from aeris.streaming import stream  # noqa: E402


@register("stream_ingest", "SELECT event_id, user_id AS station, event_type AS pollutant, value AS concentration, ts FROM events")
def stream_ingest(spark, sf_dir):
    """Two deliveries and a restart: the events up to the mark, then all of them
    again. The second run goes on from the first one's state, so every event is
    there once."""
    root = stream.stream_root(spark, "ingest")
    events = tables.table(spark, sf_dir, "events")
    part = events.where(F.col("ts") <= F.lit(EVENT_MARK).cast("timestamp_ntz"))
    for delivery in (part, events.unionAll(part)):
        delivery.write.mode("append").parquet(f"{root}/inbox/events.parquet")
        arrived = tables.as_event_readings(stream.table_stream(spark, f"{root}/inbox", "events"))
        kept = stream.merge_by_day(arrived, root)
    return kept


@register("stream_late_rows", """SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_keys,
  (SELECT 2 * count(*) FROM events) AS n_sent, (SELECT count(*) FROM events) AS n_dropped FROM events""")
def stream_late_rows(spark, sf_dir):
    """The newest events first, the oldest ones weeks later, then all again: nothing is
    lost as late, nothing is in twice, and what was dropped is counted."""
    root = stream.stream_root(spark, "late")
    events = tables.table(spark, sf_dir, "events")
    late = F.col("ts") <= F.lit(EVENT_MARK).cast("timestamp_ntz")
    for delivery in (events.where(~late), events.where(late | late.isNull()), events):
        delivery.write.mode("append").parquet(f"{root}/inbox/events.parquet")
        kept = stream.merge_by_day(stream.table_stream(spark, f"{root}/inbox", "events"), root)
    counts = stream.merge_counts(spark, root)
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_keys")).select(
        "n_rows", "n_keys", counts.agg(F.sum("n_rows")).scalar().alias("n_sent"),
        counts.agg(F.sum(F.col("n_rows") - F.col("n_new"))).scalar().alias("n_dropped"))


_SD_SQL = [q.R, q.K, q.IMP, q.D, """sd AS (SELECT d.*, n_readings FROM d JOIN
  (SELECT CAST(ts AS DATE) AS date, count(*) AS n_readings FROM k GROUP BY 1) USING (date))"""]


def _stream_daily(spark, sf_dir, name):
    return stream.drain_daily(stream.readings_stream(spark, sf_dir), stream.stream_root(spark, name))


@register("stream_daily_avg", q.with_(_SD_SQL, "SELECT date, " + q.rnd(["avg_no", "avg_no2", "avg_o3", "avg_nox"]) +
                                      ", n_readings FROM sd"))
def stream_daily_avg(spark, sf_dir):
    """Every day of the stream, imputed as in the batch rollup."""
    return r6(_stream_daily(spark, sf_dir, "daily"))


@register("stream_advice", q.with_(_SD_SQL, f"""SELECT date, {q.rd('avg_no2')} AS avg_no2, {q.rd('avg_o3')} AS avg_o3,
  CASE WHEN coalesce(avg_no2 > 20, false) OR coalesce(avg_o3 > 60, false)
    THEN concat_ws(' | ', CASE WHEN avg_no2 > 20 THEN '{NO2_TEXT}' END,
                   CASE WHEN avg_o3 > 60 THEN '{O3_TEXT}' END)
    ELSE '{SAFE_TEXT}' END AS advice, CASE """ + " ".join(
    f"WHEN ceil(avg_no2) BETWEEN {x[0]} AND {x[1]} THEN '{x[2]}'" for x in AQI_TEXT) + " END AS band FROM sd"))
def stream_advice(spark, sf_dir):
    return r6(stream.advice_daily(_stream_daily(spark, sf_dir, "advice")))


# --- model queries without an SQL oracle (rows-only check) -----------------------------
from aeris.operators import forecast, forest  # noqa: E402

MODEL_TARGETS = pl.TARGETS
MODEL_FEATURES = [c for c in ENCODED_NUMERIC if c not in MODEL_TARGETS]


def _model_columns(spark, sf_dir):
    """Encode -> log1p of skewed columns -> 70/15/15 split -> min-max fitted on train.

    Skews, positions and ranges each read the table again: it is written once before."""
    encoded = _encoded(spark, sf_dir).checkpoint(eager=True)
    indexed = ordered.row_index(stats.log1p_skewed(encoded, ENCODED_NUMERIC), "date").checkpoint(eager=True)
    sp = split.chronological_split(indexed, "date")
    return scale.minmax_by_split(sp, ENCODED_NUMERIC, "split", fit_on="train")


def _train_folds(table, k=5):
    """Shuffled folds of the train rows, which come first; the others have none."""
    n = table.where(F.col("split") == "train").select(F.count(F.lit(1))).scalar()
    fold = split.fold_of(F.col(ordered.ROW_ID), F.col("_n"), k, 42)
    return table.withColumn("_n", n).withColumn("fold", F.when(F.col("split") == "train", fold)).drop("_n")


def _model_table(spark, sf_dir):
    # iterative fits read this many times: cut the lineage once (reliable
    # checkpoint in the shared checkpoint directory)
    return _train_folds(_model_columns(spark, sf_dir).checkpoint(eager=True))


def _model_ctes():
    logged, scaled = [], []
    for c in ENCODED_NUMERIC:
        skewed = f"(SELECT coalesce(abs({_skew_sql_expr(c)}) > 0.75, false) FROM e)"
        logged.append(f"CASE WHEN {skewed} THEN (CASE WHEN {c} > -1 THEN ln(1 + {c}) END) "
                      f"ELSE CAST({c} AS DOUBLE) END AS {c}")
        lo, hi = (f"(SELECT {agg}({c}) FROM ms WHERE split = 'train')" for agg in ("min", "max"))
        scaled.append(f"({c} - {lo}) / coalesce(nullif({hi} - {lo}, 0.0), 1.0) AS {c}")
    return q.ENCODED + [
        "lg1 AS MATERIALIZED (SELECT date, " + ", ".join(logged) + " FROM e)",
        "mi AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS row_id, count(*) OVER () AS n_rows FROM lg1)",
        """ms AS MATERIALIZED (SELECT *, CASE WHEN row_id < floor(n_rows * 0.7) THEN 'train'
          WHEN row_id < floor(n_rows * 0.7) + floor(n_rows * 0.15) THEN 'val' ELSE 'test' END AS split FROM mi)""",
        *ms.fold_ctes("mt", "SELECT row_id AS id FROM ms WHERE split = 'train'", 5),
        """mt AS MATERIALIZED (SELECT date, split, row_id, n_rows, """ + ", ".join(scaled) + """,
          fold FROM ms LEFT JOIN fold_mt ON fold_mt.id = ms.row_id)"""]


@register("model_table", q.with_(_model_ctes(), "SELECT date, split, fold, " + q.rnd(ENCODED_NUMERIC) + " FROM mt"))
def model_table(spark, sf_dir):
    """The table that every model below is fitted on."""
    return r6(_train_folds(_model_columns(spark, sf_dir)).select("date", "split", "fold", *ENCODED_NUMERIC))


@register("cv_ridge")
def cv_ridge(spark, sf_dir):
    """5-fold ridge (alpha 1) on train: per-fold metrics from fold statistics."""
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    return linear.cross_validate(t, MODEL_FEATURES, MODEL_TARGETS, "fold", RIDGE_ALPHA)[0]


# Two features and one target have a closed form that SQL can write down.
TWO = ["temp", "sin_1"]


def _two_ctes():
    """Per fold f the ridge of all train rows of other folds, as c1, c2, b0."""
    return _model_ctes() + [
        f"t2 AS (SELECT fold, {TWO[0]} AS x1, {TWO[1]} AS x2, avg_o3 AS y FROM mt WHERE split = 'train' "
        f"AND {TWO[0]} IS NOT NULL AND {TWO[1]} IS NOT NULL AND avg_o3 IS NOT NULL)",
        f"""st2 AS (SELECT g.fold, count(*) * var_pop(x1) + {RIDGE_ALPHA} AS a11, count(*) * covar_pop(x1, x2) AS a12,
          count(*) * var_pop(x2) + {RIDGE_ALPHA} AS a22, count(*) * covar_pop(x1, y) AS b1,
          count(*) * covar_pop(x2, y) AS b2, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
          FROM (SELECT DISTINCT fold FROM t2) g JOIN t2 ON t2.fold <> g.fold GROUP BY g.fold)""",
        """co2 AS (SELECT fold, c1, c2, my - c1 * m1 - c2 * m2 AS b0 FROM (SELECT *,
          (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS c1,
          (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS c2 FROM st2))"""]


_TWO_SCORES = ("avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, " + _r2_sql("y", "p") + " AS r2")
_CV2 = f"""cv2 AS (SELECT fold, {_TWO_SCORES}, count(*) AS n FROM (
    SELECT t2.fold, y, b0 + c1 * x1 + c2 * x2 AS p FROM t2 JOIN co2 USING (fold)) GROUP BY fold)"""


@register("cv_ridge_two", q.with_(_two_ctes() + [_CV2], "SELECT fold, " + q.rnd(["mse", "rmse", "r2"]) + ", n FROM cv2"))
def cv_ridge_two(spark, sf_dir):
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    return r6(linear.cross_validate(t, TWO, ["avg_o3"], "fold", RIDGE_ALPHA)[0])


def _two_model(spark, sf_dir):
    m = _model_table(spark, sf_dir)
    model, folds = linear.fit_with_cv(m.where(F.col("split") == "train"), TWO, ["avg_o3"], "fold",
                                      RIDGE_ALPHA, refit="last_fold")
    return m, model, folds


_PRED2 = f"""p2 AS (SELECT date, avg_o3 AS y, b0 + c1 * {TWO[0]} + c2 * {TWO[1]} AS p FROM mt,
    (SELECT * FROM co2 WHERE fold = (SELECT max(fold) FROM co2)) WHERE split = 'test'
    AND {TWO[0]} IS NOT NULL AND {TWO[1]} IS NOT NULL)"""


@register("linear_predictions_two", q.with_(_two_ctes() + [_PRED2],
                                            "SELECT date, " + q.rd("p") + " AS pred_avg_o3 FROM p2"))
def linear_predictions_two(spark, sf_dir):
    """Test predictions of the last fold's two-feature model."""
    m, model, _ = _two_model(spark, sf_dir)
    test = clean.complete_cases(m.where(F.col("split") == "test"), TWO)
    return r6(model.predict(test).select("date", "pred_avg_o3"))


@register("linear_eval_two", q.with_(_two_ctes() + [_CV2, _PRED2], "SELECT 'cross_validation' AS split, "
          + ", ".join(q.rd(f"avg({c})") + f" AS {c}" for c in ("mse", "rmse", "r2")) + " FROM cv2 UNION ALL SELECT 'test', "
          + q.rnd(["mse", "rmse", "r2"]) + f" FROM (SELECT {_TWO_SCORES} FROM p2 WHERE y IS NOT NULL)"))
def linear_eval_two(spark, sf_dir):
    """Cross-validation means and test scores of the two-feature ridge."""
    m, model, folds = _two_model(spark, sf_dir)
    test = clean.complete_cases(m.where(F.col("split") == "test"), TWO + ["avg_o3"])
    scores = metrics.regression_metrics(model.predict(test), ["avg_o3"], ["pred_avg_o3"])
    cv = linear.fold_means(folds).select(F.lit("cross_validation").alias("split"), "mse", "rmse", "r2")
    return r6(cv.unionByName(scores.select(F.lit("test").alias("split"), "mse", "rmse", "r2")))


LASSO_ALPHA = 0.001
# Small enough for the two features to keep coefficients.
TWO_ALPHA = 0.0001


@register("lasso_fit")
def lasso_fit(spark, sf_dir):
    """Lasso of both targets on all features, from one aggregate."""
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    return linear.fit_lasso(t, MODEL_FEATURES, MODEL_TARGETS, LASSO_ALPHA).coefficients(spark)


@register("lasso_optimal", "SELECT term, target, true AS optimal FROM (VALUES " + ", ".join(
    f"('{f}')" for f in MODEL_FEATURES) + ") a(term), (VALUES " + ", ".join(f"('{t}')" for t in MODEL_TARGETS) + ") b(target)")
def lasso_optimal(spark, sf_dir):
    """Whether each coefficient meets its optimality condition on the rows themselves:
    the feature's mean product with the residual is alpha in size, with the
    coefficient's sign, or at most alpha where the coefficient is 0."""
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    found = linear.lasso_conditions(t, linear.fit_lasso(t, MODEL_FEATURES, MODEL_TARGETS, LASSO_ALPHA))
    off = F.when(F.col("coef") != 0, F.abs(F.col("slope") - LASSO_ALPHA * F.signum("coef"))).otherwise(
        F.greatest(F.abs("slope") - LASSO_ALPHA, F.lit(0.0)))
    return found.select("term", "target", (off < 1e-9).alias("optimal"))


# Means, variances and covariances of the two features and the target.
_MOMENTS2 = """avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS c11, covar_pop(x1, x2) AS c12,
  var_pop(x2) AS c22, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2"""
_LASSO2 = [f"lm2 AS (SELECT 0 AS one, {_MOMENTS2} FROM t2)",
           "lw2 AS (" + ms.lasso2("SELECT * FROM lm2", "one", str(TWO_ALPHA)) + ")"]


@register("lasso_two", q.with_(_two_ctes() + _LASSO2, f"""SELECT 'intercept' AS term, 'avg_o3' AS target, {q.rd('b0')} AS coef FROM lw2
  UNION ALL SELECT '{TWO[0]}', 'avg_o3', {q.rd('w1')} FROM lw2 UNION ALL SELECT '{TWO[1]}', 'avg_o3', {q.rd('w2')} FROM lw2"""))
def lasso_two(spark, sf_dir):
    """The two-feature lasso, which SQL finds by trying all signs."""
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    return r6(linear.fit_lasso(t, TWO, ["avg_o3"], TWO_ALPHA).coefficients(spark))


_FOLD_MOMENTS2 = (f"fm2 AS MATERIALIZED (SELECT g.fold, count(*) AS n, {_MOMENTS2} FROM (SELECT DISTINCT fold FROM t2) g "
                  "JOIN t2 ON t2.fold <> g.fold GROUP BY g.fold)")


@register("cv_lasso_two", q.with_(_two_ctes() + [
    _FOLD_MOMENTS2, "co2l AS (" + ms.lasso2("SELECT * FROM fm2", "fold", str(TWO_ALPHA)) + ")",
    f"""cvl2 AS (SELECT fold, {_TWO_SCORES}, count(*) AS n FROM (
    SELECT t2.fold, y, b0 + w1 * x1 + w2 * x2 AS p FROM t2 JOIN co2l USING (fold)) GROUP BY fold)"""],
    "SELECT fold, " + q.rnd(["mse", "rmse", "r2"]) + ", n FROM cvl2"))
def cv_lasso_two(spark, sf_dir):
    """Cross-validated two-feature lasso."""
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    return r6(linear.cross_validate(t, TWO, ["avg_o3"], "fold", TWO_ALPHA, "lasso")[0])


_HISTORY = "round int, alpha double, cv_r2 double, test_r2 double, converged boolean"


@register("overfit_loop")
def overfit_loop(spark, sf_dir):
    m = _model_table(spark, sf_dir)
    hist = linear.overfit_search(m.where(F.col("split") == "train"), m.where(F.col("split") == "test"),
                                 MODEL_FEATURES, MODEL_TARGETS, "fold", RIDGE_ALPHA, 0.1)
    return spark.createDataFrame(hist, _HISTORY)


# A gap that takes the two-feature models several rounds.
TWO_GAP = 0.006


def _overfit_sql(start: float, models: str, ended: str) -> str:
    """All rounds up to the first that meets the gap or cannot go on. ``models``: a
    select of (round, alpha, fold, w1, w2, b0); ``ended``: a condition on a round."""
    return q.with_(_two_ctes() + [
        _FOLD_MOMENTS2,
        f"al AS (SELECT CAST(i AS INTEGER) AS round, {start}::DOUBLE * (1::BIGINT << i) AS alpha FROM (SELECT unnest(range(60)) AS i))",
        f"om AS MATERIALIZED ({models})",
        f"""te2 AS (SELECT {TWO[0]} AS x1, {TWO[1]} AS x2, avg_o3 AS y FROM mt WHERE split = 'test'
          AND {TWO[0]} IS NOT NULL AND {TWO[1]} IS NOT NULL AND avg_o3 IS NOT NULL)""",
        f"""ocv AS (SELECT round, avg(r2) AS cv_r2 FROM (SELECT round, fold, {_r2_sql('y', 'p')} AS r2 FROM (
          SELECT round, om.fold, y, b0 + w1 * x1 + w2 * x2 AS p FROM t2 JOIN om USING (fold)) GROUP BY round, fold) GROUP BY round)""",
        f"""ote AS (SELECT round, {_r2_sql('y', 'p')} AS test_r2 FROM (SELECT round, y, b0 + w1 * x1 + w2 * x2 AS p
          FROM te2, om WHERE fold = (SELECT max(fold) FROM om)) GROUP BY round)""",
        f"""oh AS (SELECT round, alpha, cv_r2, test_r2, abs(cv_r2 - test_r2) <= {TWO_GAP} AS converged, {ended} AS ended
          FROM al JOIN ocv USING (round) JOIN ote USING (round))"""],
        f"""SELECT round, {q.rd('alpha')} AS alpha, {q.rd('cv_r2')} AS cv_r2, {q.rd('test_r2')} AS test_r2, converged FROM oh
      WHERE round <= (SELECT min(round) FROM oh WHERE converged OR ended)""")


def _overfit_two(spark, sf_dir, alpha, penalty):
    m = _model_table(spark, sf_dir)
    hist = linear.overfit_search(m.where(F.col("split") == "train"), m.where(F.col("split") == "test"), TWO, ["avg_o3"],
                                 "fold", alpha, TWO_GAP, penalty)
    return r6(spark.createDataFrame(hist, _HISTORY))


@register("overfit_two", _overfit_sql(RIDGE_ALPHA, """SELECT round, alpha, fold, w1, w2, my - w1 * m1 - w2 * m2 AS b0 FROM (
    SELECT *, ((n * c22 + alpha) * n * c1 - n * c12 * n * c2) / ((n * c11 + alpha) * (n * c22 + alpha) - n * c12 * n * c12) AS w1,
      ((n * c11 + alpha) * n * c2 - n * c12 * n * c1) / ((n * c11 + alpha) * (n * c22 + alpha) - n * c12 * n * c12) AS w2
    FROM al, fm2)""", f"""alpha > {linear.SHRUNK} * (SELECT count(*) * ((var_pop(x1) + var_pop(x2)) / 2 + sqrt(
      power((var_pop(x1) - var_pop(x2)) / 2, 2) + power(covar_pop(x1, x2), 2))) FROM t2)"""))
def overfit_two(spark, sf_dir):
    """Rounds of the overfit loop, two-feature ridge."""
    return _overfit_two(spark, sf_dir, RIDGE_ALPHA, "ridge")


@register("overfit_lasso_two", _overfit_sql(TWO_ALPHA, ms.lasso2("SELECT * FROM al, fm2", "round, alpha, fold", "alpha"),
                                            "NOT EXISTS (SELECT 1 FROM om WHERE om.round = al.round AND (w1 <> 0 OR w2 <> 0))"))
def overfit_lasso_two(spark, sf_dir):
    """Rounds of the overfit loop, two-feature lasso."""
    return _overfit_two(spark, sf_dir, TWO_ALPHA, "lasso")


def _forest(spark, sf_dir, features=None, params=forest.BEST):
    m = _model_table(spark, sf_dir)
    return m, forest.fit_forest(m.where(F.col("split") == "train").drop("fold"), features or MODEL_FEATURES,
                                MODEL_TARGETS, params=params)


@register("forest_fit")
def forest_fit(spark, sf_dir):
    """Test-split predictions of the forest (stored best parameters, both targets)."""
    m, found = _forest(spark, sf_dir)
    return forest.predict(found, m.where(F.col("split") == "test"))


@register("forest_importance")
def forest_importance(spark, sf_dir):
    return forest.importances(_forest(spark, sf_dir)[1])


@register("forest_fold_mse")
def forest_fold_mse(spark, sf_dir):
    """Train and validation MSE of the forest of each of five folds."""
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    return forest.fold_errors(t, MODEL_FEATURES, MODEL_TARGETS, folds=5)


@register("grid_search")
def grid_search(spark, sf_dir):
    """All 1200 points of the grid, three folds, both targets."""
    m = _train_folds(_model_table(spark, sf_dir), 3)
    return forest.grid_search(m.where(F.col("split") == "train"), MODEL_FEATURES, MODEL_TARGETS, folds=3)


# A forest small enough to be grown in SQL.
SMALL = ["temp", "humidity", "sin_1", "cos_1", "weekday"]
SMALL_PARAMS = forest.Params(max_depth=3, n_estimators=4, max_features=3, min_samples_leaf=3, min_samples_split=8, bins=16)


def _small_ctes(folds=None):
    known = " AND ".join(f"{c} IS NOT NULL" for c in SMALL + MODEL_TARGETS)
    return _model_ctes() + ms.forest_ctes("fo", f"SELECT CAST(date AS VARCHAR) AS k, fold, {', '.join(SMALL + MODEL_TARGETS)} "
                                          f"FROM mt WHERE split = 'train' AND {known}", SMALL, MODEL_TARGETS, SMALL_PARAMS, folds)


@register("forest_nodes_small", q.with_(_small_ctes(), "SELECT CAST(g AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, n, w, "
          "s0, s1, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, " + q.rd("gain / 1e12") + " AS gain FROM nodes_fo"))
def forest_nodes_small(spark, sf_dir):
    """Every node of a small forest: counts, weights, sums, split and gain."""
    nodes = _forest(spark, sf_dir, SMALL, SMALL_PARAMS)[1].nodes
    return r6(nodes.select(F.col("g").alias("tree"), "node", "n", "w", F.col("s")[0].alias("s0"), F.col("s")[1].alias("s1"),
                           "feature", "bin", (F.col("gain") / 1e12).alias("gain")))


@register("forest_fit_small", q.with_(_small_ctes() + [ms.predicted_cte(
    "fo", "pf", f"SELECT CAST(date AS VARCHAR) AS k, 0 AS forest, {', '.join(SMALL)} FROM mt WHERE split = 'test' AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in SMALL), SMALL, MODEL_TARGETS, SMALL_PARAMS)],
    "SELECT CAST(k AS DATE) AS date, " + ", ".join(f"{q.rd(f'p{i}')} AS pred_{t}" for i, t in enumerate(MODEL_TARGETS)) + " FROM pf"))
def forest_fit_small(spark, sf_dir):
    m, found = _forest(spark, sf_dir, SMALL, SMALL_PARAMS)
    return r6(forest.predict(found, m.where(F.col("split") == "test")))


@register("forest_importance_small", q.with_(_small_ctes(), "SELECT f.name AS feature, " + q.rd(
    f"coalesce(sum(share), 0.0) / {SMALL_PARAMS.n_estimators}") + " AS importance FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(SMALL)) + """) f(id, name) LEFT JOIN (SELECT feature,
    gain / sum(gain) OVER (PARTITION BY g) AS share FROM nodes_fo WHERE gain IS NOT NULL) s ON s.feature = f.id GROUP BY f.name"""))
def forest_importance_small(spark, sf_dir):
    return r6(forest.importances(_forest(spark, sf_dir, SMALL, SMALL_PARAMS)[1]))


@register("forest_fold_mse_small", q.with_(_small_ctes(5) + [ms.predicted_cte(
    "fo", "pf", f"SELECT k, forest, {', '.join(SMALL)} FROM tr_fo, (SELECT unnest(range(5)) AS forest)",
    SMALL, MODEL_TARGETS, SMALL_PARAMS)], "SELECT CAST(forest AS INTEGER) AS fold, CASE WHEN fold = forest THEN 'val' "
    "ELSE 'train' END AS part, " + q.rd("avg((power(avg_no2 - p0, 2) + power(avg_o3 - p1, 2)) / 2)") +
    " AS mse FROM pf JOIN tr_fo USING (k) GROUP BY 1, 2"))
def forest_fold_mse_small(spark, sf_dir):
    t = _model_table(spark, sf_dir).where(F.col("split") == "train")
    return r6(forest.fold_errors(t, SMALL, MODEL_TARGETS, params=SMALL_PARAMS, folds=5))


SEQ_LABELS = ["no2_week", "o3_week"]
SEQ_REG = 0.1
_SEQ_CELLS = SEQ_LEN * len(SEQ_FEATURES)


def _seq_ctes():
    """Windows written out (oldest day first), their covariances over train, and the
    ridge solved by elimination: cell i of a label in ``seq_w``."""
    cells = ", ".join(f"coalesce(CAST(b.{c} AS DOUBLE), 0.0)" for c in SEQ_FEATURES)
    labels = ", ".join(f"({k}, {c})" for k, c in enumerate(SEQ_LABELS))
    return q.BASE + [q.S, q.SP, _ROLL_SQL, f"""sw AS MATERIALIZED (SELECT date, split, {", ".join(SEQ_LABELS)}, flatten(steps) AS x
      FROM (SELECT b.date, b.split, r.no2_week, r.o3_week, list([{cells}]) OVER (PARTITION BY b.split ORDER BY b.row_id
        ROWS BETWEEN {SEQ_LEN} PRECEDING AND 1 PRECEDING) AS steps FROM sp b JOIN rb r USING (date)) WHERE len(steps) = {SEQ_LEN})""",
      f"""sy AS MATERIALIZED (SELECT date, t.k, t.y, x FROM sw, LATERAL (VALUES {labels}) t(k, y)
        WHERE split = 'train' AND t.y IS NOT NULL)""",
      f"""sl AS MATERIALIZED (SELECT date, k, unnest(list_append(x, y)) AS v, unnest(range(1, {_SEQ_CELLS + 2})) AS i FROM sy)""",
      """sc AS MATERIALIZED (SELECT a.k, a.i, b.i AS j, covar_pop(a.v, b.v) AS cov FROM sl a JOIN sl b USING (k, date)
        GROUP BY a.k, a.i, b.i)""",
      f"""sr AS (SELECT k, i, list(cov + CASE WHEN i = j THEN cov * {SEQ_REG} / sd ELSE 0 END ORDER BY j) AS r FROM sc JOIN
        (SELECT k, sqrt(cov) AS sd FROM sc WHERE i = {_SEQ_CELLS + 1} AND j = i) USING (k) WHERE i <= {_SEQ_CELLS} GROUP BY k, i)""",
      f"""walk_sq(step, k, i, r) AS (SELECT CAST(1 AS BIGINT), k, i, r FROM sr UNION ALL SELECT a.step + 1, a.k, a.i,
        CASE WHEN a.i = a.step THEN list_transform(a.r, lambda v: v / a.r[a.step])
             ELSE list_transform(range(1, {_SEQ_CELLS + 2}), lambda j: a.r[j] - a.r[a.step] / b.r[a.step] * b.r[j]) END
        FROM walk_sq a JOIN walk_sq b ON b.k = a.k AND b.i = a.step WHERE a.step <= {_SEQ_CELLS})""",
      f"""seq_w AS (SELECT k, i, r[{_SEQ_CELLS + 1}] AS w FROM walk_sq WHERE step = {_SEQ_CELLS + 1})""",
      f"""seq_b AS (SELECT k, max(CASE WHEN i = {_SEQ_CELLS + 1} THEN m END) - sum(CASE WHEN i <= {_SEQ_CELLS} THEN m * w ELSE 0 END) AS b
        FROM (SELECT k, i, avg(v) AS m FROM sl GROUP BY k, i) LEFT JOIN seq_w USING (k, i) GROUP BY k)""",
      """seq_p AS (SELECT date, no2_week, o3_week, """ + ", ".join(
          f"list_dot_product(x, (SELECT list(w ORDER BY i) FROM seq_w WHERE k = {k})) + (SELECT b FROM seq_b WHERE k = {k}) AS pred_{c}"
          for k, c in enumerate(SEQ_LABELS)) + " FROM sw WHERE split = 'test')"]


_SEQ_OUT = "SELECT date, " + q.rnd([*SEQ_LABELS, *[f"pred_{c}" for c in SEQ_LABELS]]) + " FROM seq_p"


@register("seq_moments", q.with_(_seq_ctes(), f"""SELECT label, CAST(CASE WHEN i > {_SEQ_CELLS} THEN 0 ELSE {SEQ_LEN} - (i - 1) // {len(SEQ_FEATURES)} END AS INTEGER) AS lag,
  coalesce(fi.name, label) AS feature, CAST(CASE WHEN j > {_SEQ_CELLS} THEN 0 ELSE {SEQ_LEN} - (j - 1) // {len(SEQ_FEATURES)} END AS INTEGER) AS lag_2,
  coalesce(fj.name, label) AS feature_2, {q.rd("cov")} AS cov FROM sc
  JOIN (VALUES {", ".join(f"({k}, '{c}')" for k, c in enumerate(SEQ_LABELS))}) l(k, label) USING (k)
  LEFT JOIN (VALUES {", ".join(f"({k}, '{c}')" for k, c in enumerate(SEQ_FEATURES))}) fi(n, name)
    ON i <= {_SEQ_CELLS} AND fi.n = (i - 1) % {len(SEQ_FEATURES)}
  LEFT JOIN (VALUES {", ".join(f"({k}, '{c}')" for k, c in enumerate(SEQ_FEATURES))}) fj(n, name)
    ON j <= {_SEQ_CELLS} AND fj.n = (j - 1) % {len(SEQ_FEATURES)}
  WHERE j > {_SEQ_CELLS} OR (i <= {_SEQ_CELLS} AND ({SEQ_LEN} - (i - 1) // {len(SEQ_FEATURES)}, fi.n) <= ({SEQ_LEN} - (j - 1) // {len(SEQ_FEATURES)}, fj.n))"""))
def seq_moments(spark, sf_dir):
    """Covariances of the cells of all 14-day windows of train and of their labels."""
    # read twice: means, products
    train = _rolled(spark, sf_dir).checkpoint(eager=True).where(F.col("split") == "train")
    found = forecast.window_moments(train, SEQ_FEATURES, SEQ_LABELS, SEQ_LEN, partition_by=["split"])
    return r6(spark.createDataFrame(forecast.covariances(found, SEQ_FEATURES, SEQ_LEN),
                                    "label string, lag int, feature string, lag_2 int, feature_2 string, cov double"))


def _seq_predictions(spark, sf_dir):
    # the fit reads the table twice (means, products), the forecasts once more
    r = _rolled(spark, sf_dir).checkpoint(eager=True)
    models = forecast.fit_sequence_models(r.where(F.col("split") == "train"), SEQ_FEATURES, SEQ_LABELS, SEQ_LEN,
                                          partition_by=["split"], reg=SEQ_REG)
    return forecast.predict_sequences(models, r.where(F.col("split") == "test"), partition_by=["split"],
                                      keep=("date", *SEQ_LABELS))


@register("seq_forecast", q.with_(_seq_ctes(), _SEQ_OUT))
def seq_forecast(spark, sf_dir):
    """Test-split forecasts of the 7-day means from 14-day windows."""
    return r6(_seq_predictions(spark, sf_dir))


@register("next_forecast", q.with_(_seq_ctes(), _SEQ_OUT + " ORDER BY date LIMIT 3"))
def next_forecast(spark, sf_dir):
    """The first three forecast days of the test split."""
    return r6(forecast.next_days(_seq_predictions(spark, sf_dir), 3))


# --- small inventory items ----------------------------------------------------------


@register("distinct_years", q.with_(q.BASE, "SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM f"))
def distinct_years(spark, sf_dir):
    return pl.merged_daily(spark, sf_dir).select(F.year("date").alias("year")).distinct()


@register("holiday_calendar", q.with_(q.BASE + [q.YRS, q.EAS, """hn AS (
  SELECT make_date(y, 1, 1) AS holiday_date, 'New Year''s Day' AS holiday_name FROM yrs
  UNION ALL SELECT make_date(y, 12, 25), 'Christmas Day' FROM yrs
  UNION ALL SELECT make_date(y, 12, 26), 'Second Day of Christmas' FROM yrs
  UNION ALL SELECT easter, 'Easter Sunday' FROM eas
  UNION ALL SELECT easter + 1, 'Easter Monday' FROM eas
  UNION ALL SELECT easter + 39, 'Ascension Day' FROM eas
  UNION ALL SELECT easter + 49, 'Whit Sunday' FROM eas
  UNION ALL SELECT easter + 50, 'Whit Monday' FROM eas
  UNION ALL SELECT CASE WHEN dayofweek(rb) = 0 THEN rb - 1 ELSE rb END,
    CASE WHEN y >= 2014 THEN 'King''s Day' ELSE 'Queen''s Day' END FROM
    (SELECT y, CASE WHEN y >= 2014 THEN make_date(y, 4, 27) ELSE make_date(y, 4, 30) END AS rb FROM yrs)
  UNION ALL SELECT make_date(y, 5, 5), 'Liberation Day' FROM yrs WHERE y % 5 = 0)"""],
    "SELECT DISTINCT holiday_date, holiday_name FROM hn"))
def holiday_calendar(spark, sf_dir):
    """The holiday dimension for the years present (the join variant's build side)."""
    return cal.holiday_calendar(pl.merged_daily(spark, sf_dir).select(F.year("date").alias("year")))


@register("target_summary", q.with_(q.BASE, q.union_all([
    f"SELECT '{t}' AS target, {q.rd(f'min({t})')} AS min, {q.rd(f'max({t})')} AS max, "
    f"{q.rd(f'median({t})')} AS median FROM f" for t in ["avg_no2", "avg_o3"]])))
def target_summary(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    wide = f.agg(F.array(*[F.struct(F.lit(t).alias("target"), F.min(t).alias("min"), F.max(t).alias("max"),
                                    F.median(t).alias("median")) for t in pl.TARGETS]).alias("s"))
    return r6(wide.select(F.inline("s")))


@register("dtypes", """SELECT * FROM (VALUES ('date', 'date'), ('avg_no', 'double'), ('avg_no2', 'double'),
  ('avg_o3', 'double'), ('avg_nox', 'double'), ('temp', 'double'), ('humidity', 'double'),
  ('windspeed', 'double'), ('n', 'bigint')) t("column", dtype)""")
def dtypes(spark, sf_dir):
    """Column types of the merged daily table."""
    return spark.createDataFrame(pl.merged_daily(spark, sf_dir).dtypes, "column string, dtype string")


@register("shape", q.with_(q.BASE, "SELECT count(*) AS n_rows, 9 AS n_columns FROM f"))
def shape(spark, sf_dir):
    f = pl.merged_daily(spark, sf_dir)
    return f.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(f.columns)).alias("n_columns"))


@register("split_ranges", q.with_(q.BASE + [q.S, q.SP],
                                  "SELECT split, min(date) AS min_date, max(date) AS max_date FROM sp GROUP BY split"))
def split_ranges(spark, sf_dir):
    return split.split_ranges(split.chronological_split(pl.merged_daily(spark, sf_dir), "date"))


@register("fill_zero", q.with_(q.BASE, "SELECT date, " + ", ".join(
    q.rd(f"coalesce({c}, 0)") + f" AS {c}" for c in MERGED_DOUBLES) + ", coalesce(n, 0) AS n FROM m"))
def fill_zero(spark, sf_dir):
    return r6(clean.fill_zero(pl.merged_unfilled(spark, sf_dir), FILLED_NUMERIC))


def _r3(c):
    return f"round({c}, 3)"


@register("current_display", q.with_(q.BASE, """SELECT date, CAST(round(CAST(avg_no2 AS DECIMAL(18, 6)), 3) AS DOUBLE) AS no2,
  CAST(round(CAST(avg_o3 AS DECIMAL(18, 6)), 3) AS DOUBLE) AS o3 FROM f ORDER BY date DESC LIMIT 1"""))
def current_display(spark, sf_dir):
    """Latest day's NO2 and O3 for display (3 decimals, half-up on the 6-decimal value)."""
    cur = ordered.current_row(pl.merged_daily(spark, sf_dir), "date")
    return cur.select("date", *[F.round(F.col(c).cast("decimal(18,6)"), 3).cast("double").alias(a)
                                for c, a in (("avg_no2", "no2"), ("avg_o3", "o3"))])


@register("time_format", q.with_([q.EV], """SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS next_hour,
  strftime(ts, '%Y-%m-%d') AS day, CASE WHEN pollutant = 'click' THEN 'tap' ELSE pollutant END AS pollutant FROM ev"""))
def time_format(spark, sf_dir):
    ev = tables.event_readings(spark, sf_dir)
    return ev.select("event_id", F.date_format(cal.hour_after("ts"), "yyyy-MM-dd HH:mm:ss").alias("next_hour"),
                     F.date_format("ts", "yyyy-MM-dd").alias("day"),
                     labels.replace_value("pollutant", "click", "tap").alias("pollutant"))


@register("single_target_metrics", q.with_(q.BASE + [q.S, q.SP, _ROLL_SQL], """SELECT
  """ + q.rd("avg(abs(y - p))") + " AS mae, " + q.rd("sqrt(avg((y - p) * (y - p)))") + " AS rmse, " +
    q.rd(_r2_sql("y", "p")) + """ AS r2 FROM (SELECT sp.avg_no2 AS y, rb.no2_week AS p FROM sp JOIN rb USING (date)
  WHERE sp.avg_no2 IS NOT NULL AND rb.no2_week IS NOT NULL)"""))
def single_target_metrics(spark, sf_dir):
    r = clean.complete_cases(_rolled(spark, sf_dir), ["avg_no2", "no2_week"])
    return r6(metrics.single_target_metrics(r, "avg_no2", "no2_week"))


def _linear_eval(spark, sf_dir):
    """The scaled model table re-split 60/20/20 (2 % gaps, unseen = last 5 %), and the
    ridge of the last of five folds of its train rows."""
    rs = _train_folds(split.resplit_with_gap(_model_table(spark, sf_dir).drop("split", "fold"), "date"))
    train = rs.where(F.col("split") == "train")
    model, folds = linear.fit_with_cv(train, MODEL_FEATURES, MODEL_TARGETS, "fold", RIDGE_ALPHA,
                                      refit="last_fold")
    return rs, model, folds


@register("linear_eval")
def linear_eval(spark, sf_dir):
    """The metrics document: cross-validation means, test and unseen scores of
    the ridge model (alpha 1, last-fold model), as (split, mse, rmse, r2)."""
    rs, model, folds = _linear_eval(spark, sf_dir)
    preds = [f"pred_{t}" for t in MODEL_TARGETS]
    out = linear.fold_means(folds).select(F.lit("cross_validation").alias("split"), "mse", "rmse", "r2")
    for name, cond in (("test", F.col("split") == "test"), ("unseen", F.col("unseen"))):
        part = clean.complete_cases(rs.where(cond), MODEL_FEATURES + MODEL_TARGETS)
        m = metrics.regression_metrics(model.predict(part), MODEL_TARGETS, preds)
        out = out.unionByName(m.select(F.lit(name).alias("split"), "mse", "rmse", "r2"))
    return out


@register("linear_predictions")
def linear_predictions(spark, sf_dir):
    """(date, pred_avg_no2, pred_avg_o3) for the test rows of the re-split."""
    rs, model, _ = _linear_eval(spark, sf_dir)
    test = clean.complete_cases(rs.where(F.col("split") == "test"), MODEL_FEATURES)
    return model.predict(test).select("date", *[f"pred_{t}" for t in MODEL_TARGETS])


@register("describe_events", q.union_all([
    f"""SELECT '{c}' AS column, count({c}) AS count, {q.rd(f'avg(CAST({c} AS DOUBLE))')} AS mean,
      {q.rd(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, {q.rd(f'min(CAST({c} AS DOUBLE))')} AS min,
      {q.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25,
      {q.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50,
      {q.rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75,
      {q.rd(f'max(CAST({c} AS DOUBLE))')} AS max FROM events""" for c in ["value", "user_id"]]))
def describe_events(spark, sf_dir):
    """Raw-table describe: exact percentiles by distributed sort (no single-task merge)."""
    return r6(stats.describe(tables.table(spark, sf_dir, "events"), ["value", "user_id"], method="sort"))


@register("event_skew", q.union_all([
    f"SELECT '{c}' AS column, {q.rd(_skew_sql_expr(c))} AS skew, "
    f"coalesce(abs({_skew_sql_expr(c)}) > 0.75, false) AS is_skewed FROM events" for c in ["value", "user_id"]]))
def event_skew(spark, sf_dir):
    return r6(stats.skew_table(tables.table(spark, sf_dir, "events"), ["value", "user_id"]))


@register("reunion_resplit", q.with_(q.BASE + [q.S, q.RS], "SELECT date, row_id, split, unseen FROM rs"))
def reunion_resplit(spark, sf_dir):
    """The three 70/15/15 frames re-unioned (E3), re-sorted and re-split 60/20/20 with gaps."""
    sp = split.chronological_split(pl.merged_daily(spark, sf_dir), "date").drop(ordered.ROW_ID)
    parts = [sp.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")]
    return split.resplit_with_gap(split.reunion(*parts), "date").select(
        "date", ordered.ROW_ID, "split", "unseen")


def _mm_train_sql():
    cols = []
    for c in FILLED_NUMERIC:
        lo = f"(SELECT min(CAST({c} AS DOUBLE)) FROM sp WHERE split = 'train')"
        hi = f"(SELECT max(CAST({c} AS DOUBLE)) FROM sp WHERE split = 'train')"
        cols.append(q.rd(f"(CAST({c} AS DOUBLE) - {lo}) / coalesce(nullif({hi} - {lo}, 0.0), 1.0)") + f" AS {c}")
    return q.with_(q.BASE + [q.S, q.SP], "SELECT date, split, " + ", ".join(cols) + " FROM sp")


@register("minmax_fit_train", _mm_train_sql())
def minmax_fit_train(spark, sf_dir):
    """Min-max parameters fitted on the train split only, applied to every split."""
    sp = split.chronological_split(pl.merged_daily(spark, sf_dir), "date")
    return r6(scale.minmax_by_split(sp, FILLED_NUMERIC, "split", fit_on="train")
              .select("date", "split", *FILLED_NUMERIC))


@register("current_advice", q.with_(q.BASE, f"""SELECT date, {q.rd('avg_no2')} AS avg_no2, {q.rd('avg_o3')} AS avg_o3,
  CASE WHEN coalesce(avg_no2 > 20, false) OR coalesce(avg_o3 > 60, false)
    THEN concat_ws(' | ', CASE WHEN avg_no2 > 20 THEN '{NO2_TEXT}' END,
                   CASE WHEN avg_o3 > 60 THEN '{O3_TEXT}' END)
    ELSE '{SAFE_TEXT}' END AS advice FROM f WHERE date = (SELECT max(date) FROM f)"""))
def current_advice(spark, sf_dir):
    """The dashboard's panel: the latest day's NO2, O3 and advice."""
    cur = ordered.current_row(pl.merged_daily(spark, sf_dir), "date")
    return r6(cur.select("date", "avg_no2", "avg_o3",
                         F.array_join(advisory.health_advice("avg_no2", "avg_o3"), " | ").alias("advice")))


# --- file round trips and schema operators -----------------------------------------
from aeris.sources import files  # noqa: E402


def _folder(spark, name):
    return stream.stream_root(spark, f"files-{name}")


@register("csv_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def csv_roundtrip(spark, sf_dir):
    """Headed CSV written and scanned again with an explicit schema (A1, A3)."""
    path = _folder(spark, "csv")
    files.write_table(tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"),
                      path, "csv")
    return files.read_csv(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@register("nan_ingest", """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  (SELECT count(value) FROM events WHERE event_id % 7 <> 0) AS n_values FROM events""")
def nan_ingest(spark, sf_dir):
    """Missing values that a CSV holds as NaN are NULL once read, and do not count."""
    path = _folder(spark, "nan")
    events = tables.table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    files.write_table(events, path, "csv")
    read = files.read_csv(spark, path, "event_id bigint, value double")
    return read.withColumn("n_values", read.select(F.count("value")).scalar())


@register("promoted_header", """SELECT CAST(event_id AS VARCHAR) AS event_id,
  CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type FROM events""")
def promoted_header(spark, sf_dir):
    """The first line names the columns; a value is rewritten (A2)."""
    path = _folder(spark, "header")
    files.write_table(tables.table(spark, sf_dir, "events").select("event_id", "event_type"), path, "csv")
    return files.promote_header(spark, path, {"click": "tap"}, "event_type")


@register("backup_copy", q.with_(q.BASE, "SELECT date, " + q.rnd(MERGED_DOUBLES) + ", n FROM f"))
def backup_copy(spark, sf_dir):
    """A stage's backup, read again (A4)."""
    path = files.backup(pl.merged_daily(spark, sf_dir), _folder(spark, "backup"), "merged")
    return r6(files.read_table(spark, path))


@register("predictions_csv", q.with_(_two_ctes() + [_PRED2], "SELECT date, " + q.rd("p") + " AS pred_avg_o3 FROM p2"))
def predictions_csv(spark, sf_dir):
    """Predictions as headerless CSV, read again."""
    path = _folder(spark, "predictions")
    files.write_predictions(linear_predictions_two(spark, sf_dir), path, ["pred_avg_o3"])
    return r6(files.read_csv(spark, path, "date date, pred_avg_o3 double", header=False))


@register("metrics_json", _upsert_sql())
def metrics_json(spark, sf_dir):
    """The metrics table written as JSON, damaged by a foreign line, and read again:
    the foreign line is left out (A10)."""
    path = _folder(spark, "metrics")
    metrics.write_metrics_json(_upserted(spark, sf_dir).select("model", "split", "metric", "value", "version"), path)
    spark.range(1).select(F.lit("{not json").alias("value")).write.mode("append").text(path)
    return r6(metrics.read_metrics_json(spark, path))


@register("metrics_store", _upsert_sql())
def metrics_store(spark, sf_dir):
    """Version 1 of the store holds the first scores, version 2 the upsert; then a write
    dies before its manifest, and version 2 is still what is read (A10)."""
    sp = _split_daily(spark, sf_dir)
    store = metrics.MetricsStore(spark, _folder(spark, "metrics-store"))
    store.write(metrics.to_long(_scored(spark, sf_dir, True, sp), "split", 0, "rolling7"))
    newer = metrics.to_long(_scored(spark, sf_dir, False, sp).where(F.col("split") == "test"), "split", 1, "rolling7")
    store.upsert(newer)
    store.read().limit(1).write.json(f"{store.root}/data/unfinished")
    return r6(store.read())


@register("table_append", q.with_([q.EV], f"""SELECT event_id, station, pollutant, concentration, ts, CAST(ts AS DATE) AS date,
  (SELECT max(ts) FROM ev WHERE ts <= TIMESTAMP '{EVENT_MARK}') AS mark FROM ev"""))
def table_append(spark, sf_dir):
    """A table partitioned by day takes the readings up to the mark, then all of them
    again: the mark is read from the newest day alone, and every reading is there once (A5, A8)."""
    batch, existing = _event_parts(spark, sf_dir)
    path = _folder(spark, "table")
    ingest.append_to_table(existing, path)
    mark = ingest.append_to_table(batch, path)
    return spark.read.parquet(path).select("event_id", "station", "pollutant", "concentration", "ts", "date",
                                           F.lit(mark).cast("timestamp_ntz").alias("mark"))


@register("dropped_columns", q.with_(q.BASE, "SELECT date, " + q.rnd(["avg_no2", "avg_o3"]) + " FROM f"))
def dropped_columns(spark, sf_dir):
    """Unwanted columns dropped, absent names ignored (B2)."""
    f = clean.drop_columns(pl.merged_daily(spark, sf_dir),
                           ["avg_no", "avg_nox", "temp", "humidity", "windspeed", "n", "absent"])
    return r6(f)


@register("null_keys_dropped", q.with_(q.BASE, "SELECT date, " + q.rnd(["avg_no2", "temp"]) +
                                       " FROM m WHERE date IS NOT NULL AND temp IS NOT NULL"))
def null_keys_dropped(spark, sf_dir):
    m = clean.drop_null_keys(pl.merged_unfilled(spark, sf_dir), ["date", "temp"])
    return r6(m.select("date", "avg_no2", "temp"))


@register("column_order", q.with_(q.BASE, "SELECT n, " + q.rnd(["avg_o3", "avg_no2"]) + ", date FROM f"))
def column_order(spark, sf_dir):
    return r6(clean.reorder_columns(pl.merged_daily(spark, sf_dir), ["n", "avg_o3", "avg_no2", "date"]))


@register("columns_by_type", q.with_(q.LABELLED, "SELECT date, month, weekday, holiday, high_o3_warm_months, n, day_of_year FROM l"))
def columns_by_type(spark, sf_dir):
    """Boolean and non-numeric columns, and the whole-numbered ones."""
    lab = pl.labelled_daily(spark, sf_dir)
    other = [c for c in clean.non_numeric_columns(lab) if c not in clean.boolean_columns(lab)]
    return lab.select(*other, *clean.boolean_columns(lab),
                      *[c for c in clean.numeric_columns(lab) if dict(lab.dtypes)[c] in ("int", "bigint")
                        and c != "inverse_no2_o3"])


@register("date_key", "SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def date_key(spark, sf_dir):
    """The date key derived from a text timestamp."""
    ev = tables.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("begin"))
    return clean.derive_date_key(ev, "begin").select("event_id", "date")
