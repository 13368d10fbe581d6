"""Driver tables and the sensor fixtures derived from them.

The mapping of the TPC-H-like driver tables onto sensor readings and daily
weather is fixed (see FIXTURES.md). Everything here is a lazy projection or a
grouped aggregate, so column pruning and predicate pushdown reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pollutant codes read from the driver's (returnflag, linestatus).
POLLUTANT_BY_FLAGS = {"AF": "NO", "AO": "NO2", "NF": "O3", "RO": "NOX as NO2"}
# Pollutant names used by the daily rollup.
POLLUTANTS = ["NO", "NO2", "O3", "NOX as NO2"]
# Stations kept by the station filter (fixture codes).
KEPT_STATIONS = [1, 2, 3]
# Concentrations of every 17th order are missing.
NULL_EVERY = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pollutant(flags: Column) -> Column:
    expr = None
    for code, name in POLLUTANT_BY_FLAGS.items():
        expr = (F.when(flags == code, F.lit(name)) if expr is None
                else expr.when(flags == code, F.lit(name)))
    return expr.otherwise(F.lit("other"))


def as_readings(lineitem: DataFrame) -> DataFrame:
    """The fixture mapping of line items to readings, for batch and stream alike."""
    return lineitem.select(
        (F.col("l_suppkey") % 10).cast("bigint").alias("station"),
        _pollutant(F.concat(F.col("l_returnflag"), F.col("l_linestatus"))).alias("pollutant"),
        F.when(F.col("l_orderkey") % NULL_EVERY == 0, F.lit(None).cast("double"))
         .otherwise(2 * F.col("l_quantity")).alias("concentration"),
        F.col("l_shipdate").alias("ts"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form hourly readings: (station, pollutant, concentration, ts)."""
    return as_readings(table(spark, sf_dir, "lineitem"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather: one row per order date (partial + final hash aggregate)."""
    o = table(spark, sf_dir, "orders")
    # prices carry two decimals: summing integer cents keeps the mean exact and
    # independent of summation order
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
             .agg((F.sum(cents).cast("double") / F.count(F.lit(1)) / 1000000.0).alias("temp"),
                  (F.max("o_totalprice") / 10000).alias("humidity"),
                  (F.min("o_totalprice") / 10000).alias("windspeed"),
                  F.count(F.lit(1)).alias("n")))


def as_event_readings(events: DataFrame) -> DataFrame:
    """The ``events`` table read as readings: (event_id, station, pollutant, concentration, ts)."""
    return events.select("event_id", F.col("user_id").alias("station"),
                         F.col("event_type").alias("pollutant"),
                         F.col("value").alias("concentration"), "ts")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_readings(table(spark, sf_dir, "events"))
