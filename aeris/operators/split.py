"""Chronological splits, leakage checks and folds.

Splits are positional: P1's dense row index plus range predicates on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeris.operators.ordered import ROW_ID, row_index

SPLIT_RANK = {"train": 0, "val": 1, "test": 2}
PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


def _cut(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(ratio)).cast("bigint")


def _indexed(df: DataFrame, order, id_col: str) -> tuple[DataFrame, Column]:
    indexed = df if id_col in df.columns else row_index(df, order, id_col)
    n = df.select(F.count(F.lit(1))).scalar()
    return indexed, n


def chronological_split(df: DataFrame, order, train: float = 0.7, val: float = 0.15,
                        id_col: str = ROW_ID, out: str = "split") -> DataFrame:
    """train = [0, int(.7n)), val = next int(.15n) rows, test = the rest."""
    indexed, n = _indexed(df, order, id_col)
    t_end = _cut(n, train)
    v_end = t_end + _cut(n, val)
    rid = F.col(id_col)
    return indexed.withColumn(out, F.when(rid < t_end, "train").when(rid < v_end, "val")
                              .otherwise("test"))


def resplit_with_gap(df: DataFrame, order, train: float = 0.6, val: float = 0.8,
                     gap: float = 0.02, unseen: float = 0.95, id_col: str = ROW_ID,
                     out: str = "split") -> DataFrame:
    """train [0,.6n), val [.6n+g,.8n), test [.8n+g,n), rows in a gap -> 'gap';
    ``unseen`` flags [.95n, n) (it overlaps test). An empty validation or test
    part fails the job."""
    indexed, n = _indexed(df, order, id_col)
    t, v, g, u = _cut(n, train), _cut(n, val), _cut(n, gap), _cut(n, unseen)
    rid = F.col(id_col)
    empty = F.raise_error(F.lit("Validation or test set is empty: too few rows for the gap"))
    label = (F.when((t + g >= v) | (v + g >= n), empty.cast("string")).when(rid < t, "train").when((rid >= t + g) & (rid < v), "val")
              .when(rid >= v + g, "test").otherwise("gap"))
    return indexed.withColumn(out, label).withColumn("unseen", rid >= u)


def split_ranges(df: DataFrame, date: str = "date", split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def duplicate_rows_between(df: DataFrame, cols, split: str = "split") -> DataFrame:
    """(pair, n_dup): rows equal on all ``cols`` (NULL matches NULL) between two
    splits, counted as pairs like a natural inner join would return them.

    Each side is first grouped on ``cols``; the join then meets one row per
    distinct value per split and multiplies the counts, so a value repeated
    in a third of all rows costs one row, not its square.
    """
    cols = list(cols)
    rank = F.create_map(*[x for k, v in SPLIT_RANK.items() for x in (F.lit(k), F.lit(v))])
    g = (df.where(F.col(split).isin(list(SPLIT_RANK)))
           .groupBy(split, *cols).agg(F.count(F.lit(1)).alias("_c"))
           .withColumn("_rank", rank[F.col(split)]))
    a, b = g.alias("a"), g.alias("b")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    cond.append(F.col("a._rank") < F.col("b._rank"))
    pairs = (a.join(b, cond)
               .groupBy(F.concat_ws("_", F.col(f"a.{split}"), F.col(f"b.{split}")).alias("pair"))
               .agg(F.sum(F.col("a._c").cast("decimal(19,0)") * F.col("b._c")).alias("n_dup")))
    all_pairs = df.sparkSession.createDataFrame([(f"{x}_{y}",) for x, y in PAIRS], "pair string")
    return (all_pairs.join(pairs, "pair", "left")
                     .select("pair", F.coalesce("n_dup", F.lit(0)).cast("bigint").alias("n_dup")))


def leakage_report(df: DataFrame, cols=None, date: str = "date", split: str = "split",
                   features=(), targets=()) -> DataFrame:
    """(check, pair, value): date overlap flags (val.min <= train.max,
    test.min <= val.max), duplicate-row counts for the three split pairs over
    ``cols`` (all columns but the split's own by default) and the number of
    targets that are also features."""
    cols = [c for c in df.columns if c not in (split, ROW_ID, "unseen")] if cols is None else cols
    r = split_ranges(df.where(F.col(split).isin(list(SPLIT_RANK))), date, split)
    wide = r.agg(*[F.max(F.when(F.col(split) == s, F.col(c))).alias(f"{s}_{c}")
                   for s in SPLIT_RANK for c in ("min_date", "max_date")])
    overlaps = wide.select(F.inline(F.array(
        F.struct(F.lit("date_overlap").alias("check"), F.lit("train_val").alias("pair"),
                 (F.col("val_min_date") <= F.col("train_max_date")).cast("bigint").alias("value")),
        F.struct(F.lit("date_overlap").alias("check"), F.lit("val_test").alias("pair"),
                 (F.col("test_min_date") <= F.col("val_max_date")).cast("bigint").alias("value")))))
    dups = duplicate_rows_between(df, cols, split).select(
        F.lit("duplicate_rows").alias("check"), "pair", F.col("n_dup").alias("value"))
    shared = F.lit(len(target_in_features(features, targets))).cast("bigint")
    inside = wide.select(F.lit("target_in_features").alias("check"), F.lit("all").alias("pair"),
                         shared.alias("value"))
    return overlaps.unionByName(dups).unionByName(inside)


def target_in_features(features, targets) -> list[str]:
    """Targets that also appear among the features (metadata check, H5)."""
    return [t for t in targets if t in set(features)]


ROUNDS, WALK = 6, 64


def shuffled_position(position: Column, n: Column, seed: int = 42) -> Column:
    """A keyed bijection on [0, n): where a position goes in a shuffle.

    A Feistel network over the pairs (x, y) with x < a = ceil(sqrt(n)) and y < b =
    ceil(n / a): x and y take turns at adding a hash of the other, each turn can be
    undone. What lands at n or beyond (fewer than a pairs) walks on until it lands
    inside, so the map stays one to one; up to n = 4096 no walk has more than ``WALK``
    steps, and beyond the chance of a longer one is below n^-32."""
    def drawn(turn: Column, value: Column) -> Column:
        text = F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), value.cast("string")))
        return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")

    def network(value: Column, size: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            return F.struct(F.when(i % 2 == 0, (s["x"] + drawn(i, s["y"])) % size["a"]).otherwise(s["x"]).alias("x"),
                            F.when(i % 2 == 1, (s["y"] + drawn(i, s["x"])) % size["b"]).otherwise(s["y"]).alias("y"))
        start = F.struct(F.floor(value / size["b"]).cast("long").alias("x"), (value % size["b"]).cast("long").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["x"] * size["b"] + s["y"])

    def walk(size: Column) -> Column:
        # the first step always counts, the later ones only as long as it has not landed
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"),
                           lambda v, _: F.when((v >= 0) & (v < size["n"]), v).otherwise(
                               network(F.when(v < 0, size["at"]).otherwise(v), size)))
    # bound once for a row: the count is a subquery, which the expressions below mention often
    given = F.array(F.struct(n.cast("long").alias("n"), position.cast("long").alias("at"),
                             F.ceil(F.sqrt(n.cast("double"))).cast("long").alias("a")))
    sized = F.transform(given, lambda s: F.struct(
        s["n"].alias("n"), s["at"].alias("at"), F.greatest(s["a"], F.lit(1).cast("long")).alias("a"),
        F.greatest(F.ceil(s["n"] / F.greatest(s["a"], F.lit(1).cast("long"))).cast("long"), F.lit(1).cast("long")).alias("b")))
    return F.get(F.transform(sized, walk), F.lit(0))


def fold_of(position: Column, n: Column, k: int = 5, seed: int = 42) -> Column:
    """Shuffled fold of a row's position in [0, n): sizes differ by one at most."""
    return F.floor(shuffled_position(position, n, seed) * k / n).cast("int")


def with_folds(df: DataFrame, order, k: int = 5, seed: int = 42, out: str = "fold",
               id_col: str = ROW_ID) -> DataFrame:
    """Append the shuffled fold of every row; rows are numbered by ``order`` unless they
    have a dense ``id_col``."""
    indexed, n = _indexed(df, order, id_col)
    # a column first: a subquery may not stand in a lambda
    found = indexed.withColumn("_n", n).withColumn(out, fold_of(F.col(id_col), F.col("_n"), k, seed)).drop("_n")
    return found if id_col in df.columns else found.drop(id_col)


def reunion(*splits: DataFrame) -> DataFrame:
    """Re-union split frames."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
