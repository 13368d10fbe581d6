"""Listing of folders in the cluster's storage."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones left out; none if there is no such folder."""
    fs, at = file_system(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if n[0] not in "_.")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
