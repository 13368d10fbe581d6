"""File scans and sinks (A1-A4, A9), date-key derivation (B11), target check (H5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aeris.operators import clean, split
from aeris.sources import files


def test_csv_roundtrip_with_schema_and_inference(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.5, "a"), (dt.date(2024, 1, 2), None, "b")],
                               "datetime date, temp double, name string")
    path = str(tmp_path / "weather")
    files.write_table(df, path, fmt="csv")
    inferred = files.read_csv(spark, path)
    assert sorted(inferred.columns) == ["datetime", "name", "temp"]
    typed = files.read_csv(spark, path, schema="datetime date, temp double, name string")
    assert sorted((r["datetime"], r["temp"]) for r in typed.collect()) == [
        (dt.date(2024, 1, 1), 1.5), (dt.date(2024, 1, 2), None)]


def test_promote_header_and_rename(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("name,temp\nStation A,1.0\nname,temp\nx,2.0\n")
    out = files.promote_header(spark, str(tmp_path / "raw.csv"), {"Station A": "station_a"}, "name")
    assert out.columns == ["name", "temp"]
    # a data row that looks like the header stays
    assert sorted(r["name"] for r in out.collect()) == ["name", "station_a", "x"]


def test_backup_and_predictions(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 2.0)], "date date, p1 double, p2 double")
    path = files.backup(df, str(tmp_path), "aggregated")
    assert files.read_table(spark, path).count() == 1
    out = str(tmp_path / "preds")
    files.write_predictions(df, out, ["p1", "p2"], key=None)
    back = spark.read.csv(out)
    assert back.columns == ["_c0", "_c1"] and back.count() == 1


def test_append_keeps_history(spark, tmp_path):
    from aeris.sources import ingest
    path = str(tmp_path / "readings")
    a = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "date date, v double")
    b = spark.createDataFrame([(dt.date(2024, 1, 2), 2.0)], "date date, v double")
    ingest.write_append(a, path)
    ingest.write_append(b, path)
    assert spark.read.parquet(path).count() == 2


def test_derive_date_key_raises_on_bad_value(spark):
    good = spark.createDataFrame([("2024-01-01 10:00:00",)], "begin string")
    assert clean.derive_date_key(good, "begin").first()["date"] == dt.date(2024, 1, 1)
    bad = spark.createDataFrame([("not a time",)], "begin string")
    with pytest.raises(Exception, match="resulted in NULL"):
        clean.derive_date_key(bad, "begin").collect()


def test_select_by_type_and_drop(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b double, c string, d boolean")
    assert clean.numeric_columns(df) == ["a", "b"]
    assert clean.boolean_columns(df) == ["d"]
    assert clean.drop_columns(df, ["c", "absent"]).columns == ["a", "b", "d"]


def test_target_in_features():
    assert split.target_in_features(["avg_no2", "temp"], ["avg_no2", "avg_o3"]) == ["avg_no2"]


def test_station_filter_lists_and_frames(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "station")
    assert clean.station_filter(df, list(range(0, 3000, 2))).count() == 1500
    assert clean.station_filter(df, spark.range(0, 3000, 2)).count() == 1500


def test_damaged_metrics_file_starts_empty(spark, tmp_path):
    from aeris.operators import metrics
    (tmp_path / "m.json").write_text("garbage\n[1, 2\n")
    assert metrics.read_metrics_json(spark, str(tmp_path / "m.json")).count() == 0


def test_metrics_json_roundtrip_and_upsert(spark, tmp_path):
    from aeris.operators import metrics
    path = str(tmp_path / "metrics")
    assert metrics.read_metrics_json(spark, path).count() == 0
    old = spark.createDataFrame([("lin", "test", "mse", 1.0, 0), ("lin", "cv", "mse", 2.0, 0)],
                                "model string, split string, metric string, value double, version int")
    metrics.write_metrics_json(old, path)
    new = spark.createDataFrame([("lin", "test", "mse", 0.5, 1)],
                                "model string, split string, metric string, value double, version int")
    merged = metrics.upsert(metrics.read_metrics_json(spark, path), new)
    got = {(r["split"], r["value"]) for r in merged.collect()}
    assert got == {("test", 0.5), ("cv", 2.0)}


def _stamped(spark, *stamps):
    return spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "id int, ts timestamp_ntz")


def test_table_mark_reads_the_newest_day_with_rows(spark, tmp_path):
    from aeris.sources import ingest
    path = str(tmp_path / "table")
    assert ingest.table_mark(spark, path) is None
    first = _stamped(spark, dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 7), dt.datetime(2024, 1, 2, 6), None)
    assert ingest.append_to_table(first, path) is None
    assert ingest.table_mark(spark, path) == dt.datetime(2024, 1, 2, 7)
    # newer days that hold no row, no file, or no time
    first.where("false").drop("date").write.parquet(f"{path}/date=2024-01-03")
    (tmp_path / "table" / "date=2024-01-04").mkdir()
    first.withColumn("ts", F.lit(None).cast("timestamp_ntz")).write.parquet(f"{path}/date=2024-01-05")
    assert ingest.table_mark(spark, path) == dt.datetime(2024, 1, 2, 7)
    # only the part after the mark comes in, and a second delivery adds nothing
    before = spark.read.parquet(path).count()
    second = _stamped(spark, dt.datetime(2024, 1, 2, 7), dt.datetime(2024, 1, 2, 8), dt.datetime(2024, 1, 9))
    assert ingest.append_to_table(second, path) == dt.datetime(2024, 1, 2, 7)
    assert spark.read.parquet(path).count() == before + 2
    assert ingest.append_to_table(second, path) == dt.datetime(2024, 1, 9)
    assert spark.read.parquet(path).count() == before + 2


def test_table_mark_lists_one_day(spark, tmp_path):
    from aeris.sources import ingest
    path = str(tmp_path / "table")
    ingest.append_to_table(_stamped(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)), path)
    read = ingest.day_rows(spark, path, "date=2024-01-02")
    assert all("date=2024-01-02" in f for f in read.inputFiles()) and read.first()["date"] == dt.date(2024, 1, 2)


def _metric(spark, value, version, split="test"):
    from aeris.operators import metrics
    return spark.createDataFrame([("lin", split, "mse", value, version)], metrics.METRICS_SCHEMA)


def test_killed_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    from aeris.operators import metrics
    store = metrics.MetricsStore(spark, str(tmp_path / "store"))
    assert store.versions() == [] and store.read().count() == 0
    assert store.write(_metric(spark, 1.0, 0).unionAll(_metric(spark, 4.0, 0, "cv"))) == 1
    broken = _metric(spark, 2.0, 1).withColumn("value", F.raise_error(F.lit("killed")).cast("double"))
    with pytest.raises(Exception, match="killed"):
        store.write(broken)  # while the snapshot is written
    (tmp_path / "store" / "manifest" / "2").mkdir()  # while its manifest is written
    assert store.versions() == [1]
    assert sorted(r["value"] for r in store.read().collect()) == [1.0, 4.0]
    assert store.upsert(_metric(spark, 0.5, 1)) == 3
    assert {(r["split"], r["value"]) for r in store.read().collect()} == {("test", 0.5), ("cv", 4.0)}
    assert sorted(r["value"] for r in store.read(1).collect()) == [1.0, 4.0]
    with pytest.raises(ValueError, match="no version 2"):
        store.read(2)


def test_store_retires_old_versions_and_tells_damage(spark, tmp_path):
    from aeris.operators import metrics
    store = metrics.MetricsStore(spark, str(tmp_path / "store"), keep=2)
    for i in range(4):
        store.write(_metric(spark, float(i), i))
    assert store.versions() == [3, 4] and len(list((tmp_path / "store" / "data").iterdir())) == 2
    for part in (tmp_path / "store" / "data").glob("*/*.json"):
        part.unlink()
    with pytest.raises(ValueError, match="damaged"):
        store.read()
