"""Streaming versions of ingest, daily rollup and advice.

Sources are file streams with an explicit schema over a table's path (one file or
a directory). State lives under a root folder that the caller names: a run with
the same root goes on where the last one ended. Without a name a fresh root under
the shared checkpoint directory is used.

Ingest merges by day: a micro-batch looks only at the day partitions that it touches,
so a row that is sent again, or comes a week late, is in the table once.

Daily statistics add up, so the rollup keeps no state: every micro-batch writes its
own per-day sums and counts, and the table is their sum. Every day is there, the last
one included, and a late reading is never lost. The parts are compacted like the
digits of a number: ``FAN`` parts of one size become one of the next, so n batches
leave at most FAN - 1 parts of each of log(n) sizes. A manifest names the parts that
count; what a killed run left beside it does not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.functions.advisory import aqi_band, health_advice
from aeris.operators.clean import station_filter
from aeris.operators.daily import added_stats, daily_stats, imputed_means
from aeris.session import ensure_checkpoint_dir
from aeris.sources.storage import exists as _exists, file_system as _files
from aeris.sources.tables import KEPT_STATIONS, as_readings


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """File stream over the table ``<name>.parquet``, a file or a directory of files.

    A missing table raises. ``max_files`` bounds a micro-batch; files come in the
    order of their modification time."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a pattern, as a stream's plain path must be a directory
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def event_time(col: str = "ts"):
    """Watermarks need TIMESTAMP (not NTZ). The wall clock is read as UTC
    seconds, so windows align to wall-clock days whatever the session zone."""
    c = F.col(col)
    secs = (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600
            + F.minute(c) * 60 + F.second(c))
    return F.timestamp_seconds(secs)


def dedup_stream(events: DataFrame, key: str = "event_id", ts: str = "ts",
                 delay: str = "1 hour") -> DataFrame:
    """Re-sent rows (same key) dropped within the watermark, for sinks that cannot be
    read. Rows older than the newest by more than ``delay`` are dropped as late;
    ``merge_by_day`` keeps them."""
    return (events.withColumn("_et", event_time(ts)).withWatermark("_et", delay)
                  .dropDuplicatesWithinWatermark([key]).drop("_et"))


def merge_by_day(events: DataFrame, root: str, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Drain the available rows into a table partitioned by day, each key once.

    A row that comes again has the day it had before, so a micro-batch is compared with
    its own days only. A batch that is run again finds its rows there and adds nothing.
    ``merge_counts`` tells what each batch brought and what of it was new."""
    spark, schema = events.sparkSession, events.schema
    day = F.coalesce(F.to_date(ts).cast("string"), F.lit("none"))

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_day", day).dropDuplicates([key]).persist()
        days = [r["_day"] for r in rows.select("_day").distinct().collect()]  # the days of one batch
        known = _day_table(spark, root, schema).where(F.col("_day").isin(days)).select(key)
        new = rows.join(known, key, "left_anti")
        counts = (batch.select(F.count(F.lit(1)).alias("n_rows"), F.lit(batch_id).cast("long").alias("batch_id"))
                       .withColumn("n_new", new.select(F.count(F.lit(1))).scalar()))
        if not _exists(spark, f"{root}/counts/{batch_id}/_SUCCESS"):  # a batch that is run again keeps its count
            counts.write.mode("overwrite").parquet(f"{root}/counts/{batch_id}")
        new.write.mode("append").partitionBy("_day").parquet(f"{root}/data")
        rows.unpersist()
    q = (events.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/checkpoint")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return _day_table(spark, root, schema).drop("_day")


def _day_table(spark: SparkSession, root: str, schema) -> DataFrame:
    if not _exists(spark, f"{root}/data"):
        return spark.createDataFrame([], schema).withColumn("_day", F.lit(""))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{columns}, `_day` string").parquet(f"{root}/data")


def merge_counts(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, n_rows, n_new): rows that a batch brought, and those that were new."""
    return spark.read.parquet(f"{root}/counts/*").select("batch_id", "n_rows", "n_new")


def readings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_filter(as_readings(table_stream(spark, sf_dir, "lineitem")), KEPT_STATIONS)


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex}"


# Parts of one size that become one part of the next.
FAN = 8


class Parts:
    """Statistics of ranges of batches, compacted, behind a manifest.

    A manifest is a folder ``manifest/<version>``; the greatest version that was
    written to its end counts. Parts that a newer manifest replaced go one version
    later, so that a reader of the version before still finds its files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self) -> list[int]:
        fs, at = _files(self.spark, f"{self.root}/manifest")
        found = fs.listStatus(at) if fs.exists(at) else []
        return sorted(int(f.getPath().getName()) for f in found
                      if _exists(self.spark, f"{f.getPath().toString()}/_SUCCESS"))

    def live(self) -> list[tuple[int, int, str]]:
        """(first batch, last batch, folder) of the parts that count."""
        versions = self._versions()
        if not versions:
            return []
        rows = self.spark.read.schema("first long, last long, folder string").json(
            f"{self.root}/manifest/{versions[-1]}").collect()  # logarithmic in the batches
        return sorted((r["first"], r["last"], r["folder"]) for r in rows)

    def _write(self, stats: DataFrame, first: int, last: int) -> tuple[int, int, str]:
        folder = f"{self.root}/stats/{first}-{last}-{uuid.uuid4().hex}"
        stats.write.parquet(folder)
        return first, last, folder

    def add(self, stats: DataFrame, batch_id: int) -> None:
        """Take in a batch's statistics once."""
        before = self.live()
        if any(last >= batch_id for _, last, _ in before):
            return  # a batch that is run again
        parts = [*before, self._write(stats, batch_id, batch_id)]
        size = 1
        while len(same := [p for p in parts if p[1] - p[0] + 1 == size]) >= FAN:
            merged = same[:FAN]
            parts = [p for p in parts if p not in merged]
            parts.append(self._write(added_stats(self.read(stats.schema, merged)).coalesce(1), merged[0][0], merged[-1][1]))
            size *= FAN
        versions = self._versions()
        version = (versions[-1] if versions else 0) + 1
        self.spark.createDataFrame(parts, "first long, last long, folder string").coalesce(1).write.mode(
            "overwrite").json(f"{self.root}/manifest/{version}")
        self._retire({p[2] for p in [*before, *parts]}, version)

    def _retire(self, kept: set[str], version: int) -> None:
        """Remove the parts that neither this nor the last manifest names, and older manifests."""
        fs, at = _files(self.spark, f"{self.root}/stats")
        names = {k.rsplit("/", 1)[-1] for k in kept}
        for found in fs.listStatus(at):
            if found.getPath().getName() not in names:
                fs.delete(found.getPath(), True)
        for old in self._versions():
            if old < version - 1:
                fs.delete(_files(self.spark, f"{self.root}/manifest/{old}")[1], True)

    def read(self, schema, parts=None) -> DataFrame:
        folders = [p[2] for p in (self.live() if parts is None else parts)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def drain_daily(readings: DataFrame, root: str) -> DataFrame:
    """Drain the available readings; the daily means of all readings so far, as
    the batch rollup gives them, with the number of readings."""
    def add(batch: DataFrame, batch_id: int) -> None:
        Parts(batch.sparkSession, root).add(daily_stats(batch), batch_id)

    q = (readings.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/checkpoint")
                 .trigger(availableNow=True).start())
    q.awaitTermination()
    spark = readings.sparkSession
    schema = daily_stats(spark.createDataFrame([], readings.schema)).schema
    return imputed_means(added_stats(Parts(spark, root).read(schema)), counts=True)


def advice_daily(daily: DataFrame) -> DataFrame:
    """S3: advice and air-quality band of each day."""
    return daily.select("date", "avg_no2", "avg_o3",
                        F.array_join(health_advice("avg_no2", "avg_o3"), " | ").alias("advice"),
                        aqi_band("avg_no2").alias("band"))
