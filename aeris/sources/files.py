"""File scans and sinks.

Reads take an explicit schema where one is known (no inference pass over the
data); writes are overwrite-or-append of whole partitions, never in-place edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.functions.coerce import nan_to_null

# The columns of the readings and weather files.
READINGS_SCHEMA = "station_number string, pollutant string, value double, begin timestamp_ntz, end timestamp_ntz"
WEATHER_SCHEMA = ("name string, datetime date, temp double, humidity double, precip double, "
                  "windspeed double, winddir double, visibility double, solarradiation double")


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """CSV scan; with ``schema`` None the types are inferred (one extra pass). NaN
    counts as missing."""
    r = spark.read.option("header", header)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return nan_to_null(r.csv(path))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    return nan_to_null((r.schema(schema) if schema is not None else r).load(path))


def promote_header(spark: SparkSession, path: str, rename_values: dict | None = None,
                   column: str | None = None) -> DataFrame:
    """CSV whose first line holds the names, every column as text; values of ``column``
    are optionally rewritten. The reader skips the first line of each file; data rows
    that look like it stay."""
    out = spark.read.option("header", True).csv(path)
    for old, new in (rename_values or {}).items():
        out = out.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=()) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def backup(df: DataFrame, root: str, stage: str, fmt: str = "parquet") -> str:
    """Stage backup copy under ``root/<stage>``."""
    path = f"{root.rstrip('/')}/{stage}"
    write_table(df, path, fmt)
    return path


def write_predictions(df: DataFrame, path: str, cols, key: str | None = "date") -> None:
    """Prediction columns as headerless CSV (the key column first when given)."""
    sel = ([key] if key else []) + list(cols)
    df.select(*sel).write.mode("overwrite").option("header", False).csv(path)
