"""Session construction and cluster-level helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "aeris",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Session for local runs, tests and the bench.

    Only ``conf`` and what the library relies on (UTC, AQE, no web page) is set:
    parallelism and memory are the submitter's.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.sql.session.timeZone": "UTC",
                "spark.sql.adaptive.enabled": "true",
                # checkpoints go when nothing refers to them any more
                "spark.cleaner.referenceTracking.cleanCheckpoints": "true"} | (conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def local_conf(cpus: int, memory: str = "16g") -> dict[str, str]:
    """Settings of a single-machine run with ``cpus`` threads."""
    return {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only for local runs.

    On a cluster the directory must come from ``spark.checkpoint.dir`` (a shared
    file system); a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; ordered operators need a shared "
            "checkpoint directory on a cluster")
    path = tempfile.mkdtemp(prefix="aeris-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
