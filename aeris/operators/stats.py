"""Descriptive statistics in single aggregates.

Each statistic is one pass with partial aggregation; matrices come back in long
form ``(col_a, col_b, r)`` so nothing wide is pivoted on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeris.operators.clean import numeric_columns, one_row
from aeris.session import ensure_checkpoint_dir


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def exact_quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """Exact linearly interpolated quantiles: one row (column, q0, q1, ...) per
    column, NULL without values.

    Values are counted first (combined before the shuffle, so a value that a third
    of the rows share is one row), a running count over the sorted distinct values
    gives every value its last position, and one aggregate picks the two order
    statistics around (n - 1) * p. All columns go through together."""
    from aeris.operators.ordered import running_weight
    cols = [cols] if isinstance(cols, str) else list(cols)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), _d(c).alias("_v"))
                                        for i, c in enumerate(cols)])))
    counted = long.where(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_w"))
    placed = running_weight(counted, ["_c", "_v"], "_w", "_upto")
    # one row per column
    sizes = placed.groupBy("_c").agg(F.sum("_w").alias("_n"), F.max("_upto").alias("_end"))
    placed = placed.join(F.broadcast(sizes), "_c")
    last = F.col("_upto") - (F.col("_end") - F.col("_n")) - 1
    first = last - F.col("_w") + 1
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        picks += [F.max(F.when((first <= edge(at)) & (edge(at) <= last), F.col("_v"))).alias(f"_{name}{i}")
                  for name, edge in (("lo", F.floor), ("hi", F.ceil))]
        picks.append(F.max(at - F.floor(at)).alias(f"_part{i}"))
    found = placed.groupBy("_c").agg(*picks)
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(F.get(names, F.col("_c")).alias("column"), *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(f"q{i}")
        for i in range(len(probs))])


def describe(df: DataFrame, cols=None, method: str = "memory") -> DataFrame:
    """Long-form describe: (column, count, mean, std, min, p25, p50, p75, max).

    Percentiles are exact and interpolated like pandas and DuckDB.
    ``method='memory'`` uses Spark's exact ``percentile`` aggregate, whose final
    merge holds the distinct values in one task: only for inputs with a bound
    (e.g. one row per day). ``'sort'`` is exact at any size (``exact_quantiles``).
    ``'approx'`` uses the bounded-memory ``percentile_approx`` sketch.
    """
    cols = cols or numeric_columns(df)
    probs = (0.25, 0.5, 0.75)

    def q(c, p):
        if method == "memory":
            return F.percentile(_d(c), p)
        return F.percentile_approx(_d(c), p, 10000).cast("double")

    with_q = method != "sort"
    stats = df.agg(*[F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(_d(c)).alias("mean"),
        F.stddev_samp(_d(c)).alias("std"), F.min(_d(c)).alias("min"),
        *([q(c, p).alias(f"p{int(p * 100)}") for p in probs] if with_q else []),
        F.max(_d(c)).alias("max")).alias(f"_s{i}") for i, c in enumerate(cols)])
    base = stats.select(F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(cols))])))
    if with_q:
        return base
    qs = exact_quantiles(df, cols, probs).select(
        "column", *[F.col(f"q{i}").alias(f"p{int(p * 100)}") for i, p in enumerate(probs)])
    # one row per described column on both sides
    return base.join(F.broadcast(qs), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def missing_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_missing) for every column."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing"))
        for i, c in enumerate(cols)])))


def adjusted_skewness(c) -> Column:
    """Bias-adjusted sample skewness (pandas ``skew``): NULL below 3 values,
    0 for a constant column."""
    x = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    n = F.count(x)
    g1 = F.skewness(x)
    return F.when(n > 2, F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def skew_table(df: DataFrame, cols=None, threshold: float = 0.75) -> DataFrame:
    """(column, skew, is_skewed) with is_skewed = |skew| > threshold."""
    cols = cols or numeric_columns(df)
    wide = df.agg(*[adjusted_skewness(c).alias(f"_k{i}") for i, c in enumerate(cols)])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_k{i}").alias("skew"))
        for i, c in enumerate(cols)])))
    return long.withColumn("is_skewed", F.coalesce(F.abs("skew") > threshold, F.lit(False)))


# Of a column's mean square, the part below which its variance is rounding.
NO_VARIANCE = 1e-13


def corr_long(df: DataFrame, cols=None, fill_zero: bool = True) -> DataFrame:
    """Pearson matrix as (col_a, col_b, idx_a, idx_b, r) for all ordered pairs.

    ``fill_zero`` mirrors "nulls as 0", otherwise a pair is taken over the rows that
    have both. Two reads: one row of means, then moments around them, so columns far
    from zero lose no digits. The moments are summed by null pattern (which columns a
    row has) and column, with one product sum for each other column; a pair adds up
    the patterns that hold both. Constant columns give NULL.
    """
    cols = cols or numeric_columns(df)
    p = len(cols)
    src = df.select(*[(F.coalesce(_d(c), F.lit(0.0)) if fill_zero else _d(c)).alias(f"_x{i}") for i, c in enumerate(cols)])
    # one row beside every row: in a scalar subquery, each use of a mean below would plan all of ``df`` again
    means = src.agg(F.struct(*[F.avg(f"_x{i}").alias(f"m{i}") for i in range(p)]).alias("_mean"))
    src, mean = src.crossJoin(F.broadcast(means)), F.col("_mean")
    mask = F.concat(*[F.when(F.col(f"_x{i}").isNull(), "0").otherwise("1") for i in range(p)])
    far = F.array(*[F.coalesce(F.col(f"_x{i}") - mean.getField(f"m{i}"), F.lit(0.0)) for i in range(p)])
    rows = src.select(mask.alias("mask"), far.alias("x"))
    each = rows.select("mask", "x", F.posexplode("x").alias("i", "v"))
    sums = each.groupBy("mask", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"),
                                         *[F.sum(F.col("v") * F.col("x")[j]).alias(f"p{j}") for j in range(p)])
    # one row per null pattern, its columns in order
    pattern = sums.groupBy("mask").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(
        "i", "s", F.array(*[f"p{j}" for j in range(p)]).alias("p")))).alias("m"))
    at = F.explode(F.sequence(F.lit(0), F.lit(p * p - 1))).alias("_q")
    pairs = pattern.select("*", at).select("*", F.floor(F.col("_q") / p).cast("int").alias("a"), (F.col("_q") % p).cast("int").alias("b"))
    both = (F.substr("mask", F.col("a") + 1, F.lit(1)) == "1") & (F.substr("mask", F.col("b") + 1, F.lit(1)) == "1")
    m, a, b = F.col("m"), F.col("a"), F.col("b")
    kept = {"n": F.col("n"), "sa": F.get(m, a)["s"], "sb": F.get(m, b)["s"], "aa": F.get(F.get(m, a)["p"], a),
            "bb": F.get(F.get(m, b)["p"], b), "ab": F.get(F.get(m, F.least(a, b))["p"], F.greatest(a, b))}
    total = pairs.groupBy("a", "b").agg(*[F.sum(F.when(both, x)).alias(k) for k, x in kept.items()])

    def variance(square: str, s: str) -> Column:
        v = F.col(square) / F.col("n") - (F.col(s) / F.col("n")) ** 2
        return F.when(v > NO_VARIANCE * F.col(square) / F.col("n"), v)
    cov = F.col("ab") / F.col("n") - F.col("sa") / F.col("n") * F.col("sb") / F.col("n")
    r = cov / F.sqrt(variance("aa", "sa") * variance("bb", "sb"))
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(F.get(names, a).alias("col_a"), F.get(names, b).alias("col_b"),
                        a.alias("idx_a"), b.alias("idx_b"), r.alias("r"))


def corr_lower(corr: DataFrame) -> DataFrame:
    """Strict lower triangle of a long correlation matrix."""
    return corr.where(F.col("idx_a") > F.col("idx_b"))


def corr_with_targets(corr: DataFrame, targets, threshold: float = 0.5) -> DataFrame:
    """(feature, r_<t>...) for columns with |r| > threshold on any target, self
    excluded, ordered by the largest |r| descending."""
    # a row for each pair of columns, written once: the planner would carry the matrix's
    # expressions into the conditions below, which takes it minutes
    ensure_checkpoint_dir(corr.sparkSession)
    corr = corr.checkpoint(eager=True)
    per = corr.groupBy(F.col("col_a").alias("feature")).agg(
        *[F.max(F.when(F.col("col_b") == t, F.col("r"))).alias(t) for t in targets],
        F.max(F.col("col_a").isin(list(targets))).alias("_self"))
    strongest = F.greatest(*[F.abs(F.col(t)) for t in targets])
    return (per.where(~F.col("_self") & F.greatest(*[F.abs(F.col(t)) > threshold for t in targets])).drop("_self")
               .withColumn("max_abs_r", strongest).orderBy(F.desc("max_abs_r"), "feature"))


def histogram(df: DataFrame, cols=None, bins: int = 20) -> DataFrame:
    """Equal-width histograms over [min, max] of every numeric column (or ``cols``):
    (column, bin, lo, hi, count); the last bin is closed on the right. All bounds
    come from one aggregate row, all counts from one pass."""
    cols = [cols] if isinstance(cols, str) else list(cols or numeric_columns(df))
    row = one_row(df, **{f"lo{i}": F.min(_d(c)) for i, c in enumerate(cols)},
                  **{f"hi{i}": F.max(_d(c)) for i, c in enumerate(cols)})
    long = df.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), _d(c).alias("_x"), row.getField(f"lo{i}").alias("_lo"),
        ((row.getField(f"hi{i}") - row.getField(f"lo{i}")) / float(bins)).alias("_w"))
        for i, c in enumerate(cols)])))
    b = F.when(F.col("_w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(F.col("_w"), F.lit(0.0))), F.lit(bins - 1))).cast("int")
    counted = (long.where(F.col("_x").isNotNull()).groupBy("column", b.alias("bin"))
                   .agg(F.any_value("_lo").alias("_lo"), F.any_value("_w").alias("_w"),
                        F.count(F.lit(1)).alias("count")))
    return counted.select("column", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
                          (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "count")


def quadrants(df: DataFrame, no2: str = "avg_no2", o3: str = "avg_o3",
              no2_line: float = 50.0, o3_line: float = 80.0) -> DataFrame:
    """Counts per threshold quadrant of (NO2, O3); rows with a NULL are skipped."""
    label = F.concat(F.when(F.col(no2) > no2_line, F.lit("high_no2")).otherwise(F.lit("low_no2")),
                     F.lit("/"),
                     F.when(F.col(o3) > o3_line, F.lit("high_o3")).otherwise(F.lit("low_o3")))
    return (df.where(F.col(no2).isNotNull() & F.col(o3).isNotNull())
              .groupBy(label.alias("quadrant")).agg(F.count(F.lit(1)).alias("n")))


def log1p_skewed(df: DataFrame, cols=None, threshold: float = 0.75) -> DataFrame:
    """log1p on every column whose |adjusted skew| exceeds ``threshold``.

    All decisions come from one aggregate row in a scalar subquery, so the plan
    stays lazy; every listed column comes out as double.
    """
    from aeris.functions.labels import safe_log1p
    cols = cols or numeric_columns(df)
    row = one_row(df, **{c: F.coalesce(F.abs(adjusted_skewness(c)) > threshold, F.lit(False)) for c in cols})
    return df.select(*[
        F.when(row.getField(c), safe_log1p(_d(c))).otherwise(_d(c)).alias(c) if c in cols else F.col(c)
        for c in df.columns])
