"""Regression metrics as single aggregates and the metrics table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.sources import storage

METRICS = ["mse", "rmse", "r2"]


def _r2(y: str, pred: str):
    """1 - SS_res/SS_tot; zero variance -> 1 if predictions are exact, else 0."""
    yd, pd_ = F.col(y).cast("double"), F.col(pred).cast("double")
    ss_res = F.sum((yd - pd_) * (yd - pd_))
    ss_tot = F.count(yd) * F.var_pop(yd)
    return F.when(ss_tot > 0, 1 - ss_res / ss_tot).when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def regression_metrics(df: DataFrame, targets, preds, by: str | None = None) -> DataFrame:
    """MSE over all n x t cells, RMSE = sqrt(MSE), R2 = mean of per-target R2, n."""
    sq = sum(((F.col(t).cast("double") - F.col(p).cast("double")) ** 2 for t, p in zip(targets, preds)),
             F.lit(0.0))
    mse = F.avg(sq) / F.lit(float(len(targets)))
    r2 = sum((_r2(t, p) for t, p in zip(targets, preds)), F.lit(0.0)) / F.lit(float(len(targets)))
    aggs = [mse.alias("mse"), F.sqrt(mse).alias("rmse"), r2.alias("r2"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def single_target_metrics(df: DataFrame, target: str, pred: str) -> DataFrame:
    """(mae, rmse, r2) for one target."""
    y, p = F.col(target).cast("double"), F.col(pred).cast("double")
    return df.agg(F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) ** 2)).alias("rmse"),
                  _r2(target, pred).alias("r2"))


def to_long(metrics: DataFrame, keys, version: int, model: str) -> DataFrame:
    """Wide (keys..., mse, rmse, r2) -> (model, keys..., metric, value, version)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return metrics.select(F.lit(model).alias("model"), *keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])),
        F.lit(version).alias("version"))


def upsert(existing: DataFrame, new: DataFrame, key=("model", "split", "metric")) -> DataFrame:
    """Later version wins per key; keys only in ``existing`` are kept."""
    from aeris.sources.ingest import keep_first
    both = existing.unionByName(new).withColumn("_neg_version", -F.col("version"))
    return keep_first(both, list(key), ["_neg_version", "value"], drop_cols=["_neg_version"])


def test_view(metrics: DataFrame, model: str) -> DataFrame:
    """One row (test_mse, test_r2, test_rmse) of a model's Test split."""
    t = metrics.where((F.col("model") == model) & (F.col("split") == "test"))
    return t.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"test_{m}")
                   for m in METRICS])


METRICS_SCHEMA = "model string, split string, metric string, value double, version int"


class MetricsStore:
    """Snapshots of the metrics table behind a manifest.

    A snapshot is a folder of JSON lines that is written once and never changed. Then a
    manifest ``manifest/<version>`` is written that names it and its number of rows; the
    greatest version written to its end counts. A write that dies before that leaves the
    version before as it was, and its number is not used again. Of the versions the last
    ``keep`` stay. Writers take turns: of two at a time with one number the later fails."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 10):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in storage.names(self.spark, f"{self.root}/manifest"))

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        return [n for n in self._numbers()
                if storage.exists(self.spark, f"{self.root}/manifest/{n}/_SUCCESS")]

    def _manifest(self, version: int):
        return self.spark.read.schema("folder string, n_rows long").json(
            f"{self.root}/manifest/{version}").first()

    def read(self, version: int | None = None) -> DataFrame:
        """The table at ``version`` (the newest one); empty before the first write. A
        snapshot that does not hold the rows its manifest counts raises."""
        versions = self.versions()
        if version is None and not versions:
            return self.spark.createDataFrame([], METRICS_SCHEMA)
        version = versions[-1] if version is None else version
        if version not in versions:
            raise ValueError(f"no version {version} of the metrics; there are {versions}")
        named = self._manifest(version)
        rows = self.spark.read.schema(METRICS_SCHEMA).json(f"{self.root}/data/{named['folder']}")
        if rows.count() != named["n_rows"]:
            raise ValueError(f"version {version} of the metrics is damaged: {named['n_rows']} rows expected")
        return rows

    def write(self, metrics_long: DataFrame) -> int:
        """Write the whole table as the next version and return its number."""
        number = max(self._numbers(), default=0) + 1
        folder = uuid.uuid4().hex
        where = f"{self.root}/data/{folder}"
        metrics_long.select("model", "split", "metric", "value", "version").write.json(where)
        n_rows = self.spark.read.schema(METRICS_SCHEMA).json(where).count()
        self.spark.createDataFrame([(folder, n_rows)], "folder string, n_rows long").coalesce(1).write.json(
            f"{self.root}/manifest/{number}")
        self._retire()
        return number

    def upsert(self, new: DataFrame) -> int:
        """The newest version with ``new`` taken in: the later version wins per key."""
        return self.write(upsert(self.read(), new))

    def _retire(self) -> None:
        versions = self.versions()
        kept, gone = versions[-self.keep:], versions[:-self.keep]
        for number in gone:  # the manifest first: a snapshot without one is not read
            folder = self._manifest(number)["folder"]
            storage.remove(self.spark, f"{self.root}/manifest/{number}")
            if folder not in {self._manifest(n)["folder"] for n in kept}:
                storage.remove(self.spark, f"{self.root}/data/{folder}")


def write_metrics_json(metrics_long: DataFrame, path: str) -> None:
    """Export the long metrics table as JSON lines, in the place of what is there. A table
    that must outlive a killed write belongs in a ``MetricsStore``."""
    metrics_long.write.mode("overwrite").json(path)


def read_metrics_json(spark, path: str) -> DataFrame:
    """Read a metrics table written by ``write_metrics_json``. A missing location
    gives an empty table, and lines that are no metrics records are left out (a
    corrupt file starts empty); any other error, such as a forbidden read, is raised."""
    from pyspark.errors import AnalysisException
    schema = METRICS_SCHEMA
    try:
        rows = spark.read.schema(schema + ", _bad string").option(
            "columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.where("_bad is null and model is not null and metric is not null").drop("_bad")
