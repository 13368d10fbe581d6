"""Scaling (F13, F14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeris.operators.clean import numeric_columns, one_row


def _safe_range(lo: Column, hi: Column) -> Column:
    return F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0))


def minmax_by_split(df: DataFrame, cols=None, split: str = "split",
                    fit_on: str | None = None) -> DataFrame:
    """Min-max scale ``cols`` to [0, 1] with min/max fitted per split (constant
    column -> 0). With ``fit_on`` set, the parameters of that split are applied
    to every row instead (no leakage from later splits)."""
    cols = cols or [c for c in numeric_columns(df) if c != split]

    def bounds(c):
        x = F.col(c).cast("double")
        return {f"_lo_{c}": F.min(x), f"_hi_{c}": F.max(x)}
    aggs = {k: v for c in cols for k, v in bounds(c).items()}
    if fit_on is None:
        stats = df.groupBy(split).agg(*[a.alias(name) for name, a in aggs.items()])
        joined = df.join(stats, split, "left")
        at = F.col
    else:
        joined = df
        row = one_row(df.where(F.col(split) == fit_on), **aggs)
        at = row.getField
    return joined.select(*[
        ((F.col(c).cast("double") - at(f"_lo_{c}")) / _safe_range(at(f"_lo_{c}"), at(f"_hi_{c}"))).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def zscore(df: DataFrame, cols=None) -> DataFrame:
    """(x - mean) / population std; constant column -> 0. All means and deviations
    come from one aggregate row."""
    cols = cols or numeric_columns(df)
    row = one_row(df, **{f"mu_{c}": F.avg(F.col(c).cast("double")) for c in cols},
                  **{f"sd_{c}": F.stddev_pop(F.col(c).cast("double")) for c in cols})
    return df.select(*[
        ((F.col(c).cast("double") - row.getField(f"mu_{c}"))
         / F.coalesce(F.nullif(row.getField(f"sd_{c}"), F.lit(0.0)), F.lit(1.0))).alias(c)
        if c in cols else F.col(c) for c in df.columns])
