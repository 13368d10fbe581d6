"""Streams equal the batch oracle, read directory tables and resume."""

import duckdb

from tests.conftest import SMOKE_DIR
from tools.oracle_check import canon

import __spark_entry__ as entry
from aeris.sources import tables
from aeris.streaming import stream


def test_streams_match_batch_oracle(spark):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    for name in ("stream_ingest", "stream_late_rows", "stream_daily_avg", "stream_advice"):
        df = entry.queries()[name](spark, SMOKE_DIR)
        rel = con.sql(entry.oracle_sql()[name])
        assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())


def test_directory_table_and_resume(spark, tmp_path):
    """A table of several files, then more files: the second run adds only these."""
    line = tables.table(spark, SMOKE_DIR, "lineitem").cache()
    folder, root = f"{tmp_path}/lineitem.parquet", f"{tmp_path}/state"
    line.where("l_orderkey % 2 = 0").repartition(3).write.parquet(folder)
    first = stream.drain_daily(stream.readings_stream(spark, str(tmp_path)), root)
    assert first.agg({"n_readings": "sum"}).first()[0] == line.where(
        "l_orderkey % 2 = 0 and l_suppkey % 10 in (1, 2, 3)").count()
    line.where("l_orderkey % 2 = 1").repartition(2).write.mode("append").parquet(folder)
    both = stream.drain_daily(stream.readings_stream(spark, str(tmp_path)), root)
    again = stream.drain_daily(stream.readings_stream(spark, str(tmp_path)), root)
    whole = entry.queries()["stream_daily_avg"](spark, SMOKE_DIR)
    rows = [canon(d.columns, [tuple(r) for r in d.collect()]) for d in (both, again, whole)]
    assert rows[0] == rows[1] == rows[2]
    line.unpersist()


def test_missing_table_raises(spark, tmp_path):
    import pytest
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stream.table_stream(spark, str(tmp_path), "absent")


def _stats(spark, day, n):
    return spark.createDataFrame([(day, n)], "d string, n long")


def test_parts_are_logarithmic_and_survive_kills(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(stream, "added_stats", lambda df: df.groupBy("d").agg(F.sum("n").alias("n")))
    monkeypatch.setattr(stream, "FAN", 3)
    parts = stream.Parts(spark, f"{tmp_path}/state")
    total = {}
    for batch in range(14):
        if batch in (5, 8, 9):  # killed before the manifest was written, once inside a compaction
            with monkeypatch.context() as m:
                m.setattr(stream.Parts, "_versions", lambda self, f=stream.Parts._versions, c=[]: (
                    f(self) if len(c) < 1 and not c.append(1) else (_ for _ in ()).throw(RuntimeError("killed"))))
                try:
                    parts.add(_stats(spark, f"d{batch % 3}", batch), batch)
                except RuntimeError:
                    pass
        for _ in range(2):  # a batch may be run again
            parts.add(_stats(spark, f"d{batch % 3}", batch), batch)
        total[f"d{batch % 3}"] = total.get(f"d{batch % 3}", 0) + batch
        got = parts.read("d string, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
        assert {r["d"]: r["n"] for r in got} == total
        live = parts.live()
        assert len(live) <= 2 * 3 and live[0][0] == 0 and live[-1][1] == batch
        assert all(a[1] + 1 == b[0] for a, b in zip(live, live[1:]))
    import os
    assert len(os.listdir(f"{tmp_path}/state/stats")) <= 10 and len(os.listdir(f"{tmp_path}/state/manifest")) <= 2


def test_merge_by_day_takes_null_times_and_late_rows(spark, tmp_path):
    import datetime as dt
    kinds = "event_id long, ts timestamp_ntz, v long"
    root, inbox = f"{tmp_path}/state", f"{tmp_path}/in"
    deliveries = [[(1, dt.datetime(2024, 5, 9), 1), (2, None, 2)], [(3, dt.datetime(2024, 1, 1), 3), (2, None, 2)],
                  [(1, dt.datetime(2024, 5, 9), 1), (4, dt.datetime(2024, 5, 9, 1), 4), (4, dt.datetime(2024, 5, 9, 1), 4)]]
    for rows in deliveries:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{inbox}/t.parquet")
        kept = stream.merge_by_day(stream.table_stream(spark, inbox, "t"), root)
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == ["event_id", "ts", "v"]
    counts = stream.merge_counts(spark, root).orderBy("batch_id").collect()
    assert [(r["n_rows"], r["n_new"]) for r in counts] == [(2, 2), (2, 1), (3, 1)]
