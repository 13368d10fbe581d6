"""The reference's three stages as lazy Spark plans.

L1 ``merged_daily``: readings -> station filter -> mean imputation -> daily
conditional averages -> full outer join with daily weather -> forward fill in
date order. L2 ``labelled``: calendar, holiday, threshold and Fourier columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.functions import calendar as cal
from aeris.functions import labels
from aeris.operators.clean import station_filter
from aeris.operators.daily import daily_pivot_avg_imputed, outer_merge
from aeris.operators.ordered import ROW_ID, forward_fill
from aeris.sources.tables import KEPT_STATIONS, readings, weather

POLLUTANT_COLS = ["avg_no", "avg_no2", "avg_o3", "avg_nox"]
WEATHER_COLS = ["temp", "humidity", "windspeed", "n"]
TARGETS = ["avg_no2", "avg_o3"]


def kept_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_filter(readings(spark, sf_dir), KEPT_STATIONS)


def daily_pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of the mean-imputed kept readings, in one scan of the readings."""
    return daily_pivot_avg_imputed(kept_readings(spark, sf_dir))


def merged_unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outer_merge(daily_pollutants(spark, sf_dir), weather(spark, sf_dir), "date")


def merged_daily(spark: SparkSession, sf_dir: str, keep_index: bool = False) -> DataFrame:
    """One row per date, pollutant and weather columns forward-filled by date."""
    m = merged_unfilled(spark, sf_dir)
    # both sides of the merge are grouped by date
    filled = forward_fill(m, POLLUTANT_COLS + WEATHER_COLS, "date", one_row_per_date=True)
    return filled if keep_index else filled.drop(ROW_ID)


def add_labels(df: DataFrame, date: str = "date", no2: str = "avg_no2",
               o3: str = "avg_o3") -> DataFrame:
    """Month, holiday, weekday, warm-month high O3, inverse flag, |NO2-O3|,
    day of year and Fourier terms."""
    out = df.withColumn("month", cal.month_name(date))
    out = cal.with_holiday_flag(out, date, "holiday")
    doy = cal.day_of_year(date)
    return out.select(
        "*",
        cal.weekday_name(date).alias("weekday"),
        labels.warm_high_o3(o3, date).alias("high_o3_warm_months"),
        labels.inverse_no2_o3(no2, o3).alias("inverse_no2_o3"),
        labels.relative_difference(no2, o3).alias("relative_difference"),
        doy.alias("day_of_year"),
        *cal.fourier_terms(doy),
    )


def labelled_daily(spark: SparkSession, sf_dir: str, keep_index: bool = False) -> DataFrame:
    return add_labels(merged_daily(spark, sf_dir, keep_index))


def encoded(df: DataFrame) -> DataFrame:
    """Month/weekday names -> numbers, booleans -> 0/1."""
    out = df.withColumn("month", cal.month_number("month")) \
            .withColumn("weekday", cal.weekday_number("weekday"))
    return labels.bools_to_int(out)
