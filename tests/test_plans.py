"""Plan assertions: pruning/pushdown reach the scan, no Python in the hot path,
no un-partitioned window over data rows."""

from tests.conftest import SMOKE_DIR

from aeris.plans import pipeline as pl
from aeris.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    plan = _plan(pl.kept_readings(spark, SMOKE_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string" in plan


def test_no_python_udf_in_daily_plan(spark):
    plan = _plan(pl.labelled_daily(spark, SMOKE_DIR))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_fill_window_is_partitioned(spark):
    m = pl.merged_daily(spark, SMOKE_DIR)
    plan = _plan(m)
    # every data-row window is partitioned by the block column
    for line in plan.splitlines():
        if "Window [" in line and "_e_" not in line:
            assert "_blk" in line, line


def test_pushed_filter(spark):
    from pyspark.sql import functions as F
    df = tables.table(spark, SMOKE_DIR, "events").where(F.col("value") > 10).select("value")
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in _plan(df)


def _windows(plan: str):
    return [line for line in plan.splitlines() if "Window [" in line]


def test_ordered_query_windows_are_blocked(spark):
    """Windows over data rows are partitioned by the block column; the only
    other windows run over per-partition offsets or per-block summaries."""
    from aeris.plans import catalogue
    for name in ("rolling_mean7", "sequence_windows", "split_70_15_15"):
        df = catalogue.QUERIES[name](spark, SMOKE_DIR)
        df.collect()
        for line in _windows(df._jdf.queryExecution().executedPlan().toString()):
            assert "_blk" in line or "_pid" in line, (name, line[:200])
