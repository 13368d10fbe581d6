"""Threshold labels and value transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeris.functions.calendar import WARM_MONTHS, month_name

# Label thresholds.
HIGH_O3 = 80.0
INVERSE_NO2_HIGH = 20.0
INVERSE_O3_LOW = 39.98
INVERSE_NO2_LOW = 10.23
INVERSE_O3_HIGH = 63.39


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def warm_high_o3(o3, date) -> Column:
    """O3 > 80 in May..September; NULL O3 -> false."""
    return F.coalesce((_c(o3) > HIGH_O3) & month_name(date).isin(WARM_MONTHS),
                      F.lit(False))


def inverse_no2_o3(no2, o3) -> Column:
    """1 when (NO2 > 20 and O3 < 39.98) or (NO2 < 10.23 and O3 > 63.39), else 0."""
    hit = ((_c(no2) > INVERSE_NO2_HIGH) & (_c(o3) < INVERSE_O3_LOW)) | \
          ((_c(no2) < INVERSE_NO2_LOW) & (_c(o3) > INVERSE_O3_HIGH))
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))


def relative_difference(no2, o3) -> Column:
    return F.abs(_c(no2) - _c(o3))


def bools_to_int(df: DataFrame) -> DataFrame:
    """Every boolean column -> 0/1 integer (decided from the schema)."""
    return df.select(*[F.col(f.name).cast("int").alias(f.name)
                       if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
                       for f in df.schema.fields])


def safe_log1p(x) -> Column:
    """log(1 + x); NULL where x <= -1 (undefined)."""
    return F.when(_c(x) > -1, F.log1p(_c(x)))


def replace_value(col, old: str, new: str) -> Column:
    return F.when(_c(col) == old, F.lit(new)).otherwise(_c(col))
