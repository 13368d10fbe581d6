"""Filters, drops, imputations and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def station_filter(df: DataFrame, stations, col: str = "station") -> DataFrame:
    """Keep rows whose ``col`` is in ``stations`` (a list or a one-column DataFrame)."""
    if isinstance(stations, DataFrame):
        keys = stations.select(F.col(stations.columns[0]).alias(col)).distinct()
        return df.join(keys, col, "left_semi")
    return df.where(F.col(col).isin(list(stations)))


def one_row(df: DataFrame, **aggregates) -> Column:
    """A struct of aggregates of ``df`` as one scalar subquery: however many of its
    fields a plan uses, ``df`` is read once for them."""
    return df.agg(F.struct(*[a.alias(name) for name, a in aggregates.items()]).alias("_row")).scalar()


def drop_columns(df: DataFrame, columns) -> DataFrame:
    """Drop columns; absent names are ignored."""
    return df.drop(*[c for c in columns if c in df.columns])


def drop_null_keys(df: DataFrame, keys) -> DataFrame:
    return df.na.drop(subset=list(keys))


def complete_cases(df: DataFrame, columns) -> DataFrame:
    """Rows with every one of ``columns`` non-null (features and targets jointly)."""
    return df.na.drop(subset=list(dict.fromkeys(columns)))


def mean_impute(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Replace NULLs in ``col`` by its mean over all rows (or per ``by`` group).

    The global mean is a scalar subquery: Spark runs one partial/final
    aggregate and inlines the value, no join and no driver round trip.
    """
    if by is None:
        mean = df.select(F.avg(col)).scalar()
        return df.withColumn(col, F.coalesce(F.col(col), mean))
    means = df.groupBy(by).agg(F.avg(col).alias("_mean"))
    return (df.join(means, by, "left")
              .withColumn(col, F.coalesce(F.col(col), F.col("_mean")))
              .drop("_mean"))


def fill_zero(df: DataFrame, columns=None) -> DataFrame:
    """Numeric NULLs -> 0."""
    cols = columns or numeric_columns(df)
    return df.na.fill(0, subset=list(cols))


def reorder_columns(df: DataFrame, ordered) -> DataFrame:
    """Project ``ordered`` columns, raising with the list of missing names."""
    missing = [c for c in ordered if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df.select(*ordered)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _NUMERIC)]


def derive_date_key(df: DataFrame, source: str, out: str = "date") -> DataFrame:
    """Add ``out`` = date of ``source`` if absent; an unparseable value fails the job.

    The check runs inside the projection (``raise_error``), not as a separate
    counting job.
    """
    if out in df.columns:
        return df
    d = F.to_date(F.col(source)) if not isinstance(df.schema[source].dataType, T.StringType) \
        else F.to_date(F.try_to_timestamp(F.col(source)))
    return df.withColumn(out, F.when(d.isNull(), F.raise_error(
        F.lit(f"Conversion of '{source}' to '{out}' resulted in NULL values"))).otherwise(d))


def coverage_gap(left: DataFrame, right: DataFrame, key: str = "date") -> DataFrame:
    """Keys of ``left`` absent from ``right`` (empty result = full coverage)."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")
