"""Lenient coercion: unparseable values become NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_timestamp_or_null(col, fmt: str | None = None) -> Column:
    if fmt is None:
        return F.try_to_timestamp(_c(col))
    return F.try_to_timestamp(_c(col), F.lit(fmt))


def to_double_or_null(col) -> Column:
    return _c(col).try_cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values that come as NaN become NULL in every float and double column:
    Spark counts NaN as a value, greater than all others."""
    return df.select(*[F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema.fields])
