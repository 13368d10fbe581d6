"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.session import ensure_checkpoint_dir

# The two alphabets of the A-Z fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what separates the words of a folded text (ASCII that is no letter or digit).
DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ship_code(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application: they
    need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_aeris_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    # the driver serves the file from here; the folder goes with the application
    folder = os.path.join(SparkFiles.getRootDirectory(), f"code-{uuid.uuid4().hex}")
    os.makedirs(folder)
    with zipfile.ZipFile(f"{folder}/aeris-code.zip", "w") as code:
        for at, _, names in os.walk(f"{root}/aeris"):
            for name in sorted(names):
                if name.endswith(".py"):
                    code.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", root))
    context.addPyFile(f"{folder}/aeris-code.zip")
    context._aeris_shipped = True


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back.

    This cuts the lineage (a lost executor costs no recomputation) and gives
    the planner the real size, so that a later join broadcasts only a side it
    knows to be small. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the
    body (or a lambda inside it) mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_case(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def folded_words(text: Column) -> Column:
    """The words of a text after the A-Z fold; null and empty texts have none."""
    return F.array_remove(F.split(fold_case(F.coalesce(text, F.lit(""))), DELIMITERS), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
