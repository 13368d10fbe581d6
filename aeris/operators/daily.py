"""Daily rollup, pivots and the outer merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeris.sources.tables import POLLUTANTS

# Output column per pollutant name.
DAILY_COLUMNS = {"NO": "avg_no", "NO2": "avg_no2", "O3": "avg_o3", "NOX as NO2": "avg_nox"}
# Pollutants whose day without readings counts as 0 instead of NULL.
ZERO_WHEN_ABSENT = ["NOX as NO2"]


def daily_stats(readings: DataFrame, ts: str = "ts", pollutant: str = "pollutant",
                value: str = "concentration", keys=(), pollutants=POLLUTANTS) -> DataFrame:
    """Per day (and optional entity keys) and pollutant: the sum and count of
    present values and the count of missing ones. These add up: statistics of
    parts, or of micro-batches, sum to those of the whole.

    One conditional aggregate: partial aggregation on the map side reduces every
    input partition to at most (#days x #keys) rows before the shuffle, so a hot
    day costs no more than any other. Rows without a date form a NULL day; they
    count towards the mean.
    """
    v, p = F.col(value), F.col(pollutant)
    aggs = [F.coalesce(F.sum(v), F.lit(0.0)).alias("_s_all"), F.count(v).alias("_k_all"),
            F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(pollutants):
        aggs += [F.coalesce(F.sum(F.when(p == name, v)), F.lit(0.0)).alias(f"_s{i}"),
                 F.count(F.when(p == name, v)).alias(f"_k{i}"),
                 F.count_if((p == name) & v.isNull()).alias(f"_z{i}")]
    return readings.groupBy(*keys, F.to_date(F.col(ts)).alias("date")).agg(*aggs)


def added_stats(stats: DataFrame, keys=(), pollutants=POLLUTANTS) -> DataFrame:
    """The sum of ``daily_stats`` of several parts."""
    names = ["_s_all", "_k_all", "_rows"] + [f"_{x}{i}" for i in range(len(pollutants)) for x in "skz"]
    return stats.groupBy(*keys, "date").agg(*[F.sum(n).alias(n) for n in names])


def imputed_means(stats: DataFrame, keys=(), pollutants=POLLUTANTS, counts: bool = False) -> DataFrame:
    """Daily means of the readings behind ``stats`` with every NULL replaced by the
    mean over all rows: (sum + missing * mean) / (present + missing). ``stats`` is
    read twice, for the mean and for the days: give it materialised."""
    mean = stats.select(F.sum("_s_all") / F.sum("_k_all")).scalar()
    out = []
    for i, name in enumerate(pollutants):
        z = F.col(f"_z{i}")
        filled = F.col(f"_s{i}") + F.when(z > 0, z * mean).otherwise(F.lit(0.0))
        n = F.col(f"_k{i}") + z
        a = F.when(n > 0, filled / n)
        if name in ZERO_WHEN_ABSENT:
            a = F.coalesce(a, F.lit(0.0))
        out.append(a.alias(DAILY_COLUMNS.get(name, f"avg_{name}")))
    if counts:
        out.append(F.col("_rows").cast("bigint").alias("n_readings"))
    return stats.where(F.col("date").isNotNull()).select(*keys, "date", *out)


def daily_pivot_avg_imputed(readings: DataFrame, ts: str = "ts", pollutant: str = "pollutant",
                            value: str = "concentration", keys=(), pollutants=POLLUTANTS) -> DataFrame:
    """Per day mean concentration of each pollutant after mean imputation, in one
    scan: the per-day statistics (days x pollutants numbers) are checkpointed once,
    so the mean and the final projection both read the small table."""
    from aeris.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(readings.sparkSession)
    stats = daily_stats(readings, ts, pollutant, value, keys, pollutants).checkpoint(eager=True)
    return imputed_means(stats, keys, pollutants)


def pivot_mean(df: DataFrame, index: str, columns: str, values: str,
               column_values=None) -> DataFrame:
    """pivot_table(mean): one row per ``index``, one column per ``columns`` value.

    Without ``column_values`` the values are found first (one distinct job), so no
    value is left out; a given list is a selection.
    """
    g = df.groupBy(index)
    g = g.pivot(columns, list(column_values)) if column_values is not None else g.pivot(columns)
    return g.agg(F.avg(values))


def outer_merge(left: DataFrame, right: DataFrame, key: str = "date") -> DataFrame:
    """Full outer equi-join on ``key``; the key is coalesced from both sides."""
    return left.join(right, key, "full")
