"""Incremental ingest, unions and keep-first dedup.

History is never rewritten: a batch keeps only rows after the high-water mark
and is appended; the mark is the maximum end timestamp of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.sources import storage


def high_water_mark(df: DataFrame, ts: str = "ts"):
    """The mark as a scalar-subquery column (max of ``ts``)."""
    return df.select(F.max(ts)).scalar()


def new_rows(batch: DataFrame, mark, ts: str = "ts") -> DataFrame:
    """Rows of ``batch`` strictly after ``mark`` (a literal or a scalar column);
    without a mark (NULL, an empty target) every row is new."""
    mark = mark if isinstance(mark, Column) else F.lit(mark)
    return batch.where(mark.isNull() | (F.col(ts) > mark))


def append_after_mark(existing: DataFrame, batch: DataFrame, ts: str = "ts",
                      mark=None) -> DataFrame:
    """New rows first, then the existing ones (union all); nothing new -> the
    existing rows unchanged. ``is_new`` marks the delta."""
    mark = high_water_mark(existing, ts) if mark is None else mark
    fresh = new_rows(batch, mark, ts).withColumn("is_new", F.lit(True))
    return fresh.unionByName(existing.withColumn("is_new", F.lit(False)))


def write_append(df: DataFrame, path: str, partition_by=("date",), fmt: str = "parquet") -> None:
    """Append the delta to a date-partitioned table (old partitions untouched)."""
    df.write.mode("append").partitionBy(*partition_by).format(fmt).save(path)


def table_mark(spark: SparkSession, path: str, ts: str = "ts", day: str = "date"):
    """The mark of a table that ``write_append`` partitioned by the day of ``ts``: the
    newest day from the folder names, then the maximum inside it, so one day is read
    whatever the table's size. A day without rows, or without a time, leads on to the day
    before. None without any mark or table."""
    prefix = f"{day}="
    # rows without a day have no time either: their folder's name is no date
    days = [n for n in storage.names(spark, path) if n.startswith(prefix) and n[len(prefix):][:1].isdigit()]
    for name in sorted(days, reverse=True):
        if storage.names(spark, f"{path}/{name}"):
            mark = day_rows(spark, path, name).agg(F.max(ts).alias("mark")).first()["mark"]
            if mark is not None:
                return mark
    return None


def day_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one partition folder; no other folder is listed."""
    return spark.read.option("basePath", path).parquet(f"{path}/{name}")


def append_to_table(batch: DataFrame, path: str, ts: str = "ts", day: str = "date"):
    """Append the rows of ``batch`` after the table's mark under the day of ``ts``; returns
    the mark that was found. A table that is not there yet takes the whole batch."""
    mark = table_mark(batch.sparkSession, path, ts, day)
    # a literal of the column's own type
    fresh = new_rows(batch, F.lit(mark).cast(batch.schema[ts].dataType), ts)
    write_append(fresh.withColumn(day, F.to_date(ts)), path, (day,))
    return mark


def last_available_date(df: DataFrame, col: str):
    """max of the column parsed leniently, formatted yyyy-MM-dd (one row)."""
    parsed = F.try_to_timestamp(F.col(col).cast("string"))
    return df.select(F.date_format(F.max(parsed), "yyyy-MM-dd").alias("last_date"))


def union_sources(old: DataFrame, new: DataFrame, rank_col: str = "source_rank") -> DataFrame:
    """Union by name (missing columns NULL), old rows ranked 0, new rows 1."""
    return (old.withColumn(rank_col, F.lit(0))
               .unionByName(new.withColumn(rank_col, F.lit(1)), allowMissingColumns=True))


def keep_first(df: DataFrame, key, order, drop_cols=()) -> DataFrame:
    """One row per ``key``: the first by ``order`` (a list of column names that
    makes the choice total).

    An aggregate (``min_by`` over a struct), not a window: map-side partial
    aggregation keeps one row per key per partition, so a key repeated in a
    third of the rows never lands whole in one task.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    out = df.groupBy(*key).agg(best.alias("_r")).select(*key, "_r.*")
    return out.drop(*drop_cols)


def duplicate_count(df: DataFrame, key) -> DataFrame:
    """Number of surplus rows on ``key`` (rows minus distinct keys)."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
