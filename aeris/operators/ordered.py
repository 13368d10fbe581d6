"""Ordered operators without un-partitioned windows over data rows.

P1 ``row_index``: a dense global position 0..n-1 in a total order. Bounds on the
full sort key (so heavy ties on the first column are split by the later ones) are
read off the rows of least key hash, a sample of bounded size that is the same in
every run. A row's range is the number of bounds up to it; its position is its row
number inside the range plus the rows of earlier ranges, from a table of one row
per range broadcast back. All of it is one lazy plan: the data is not copied, and
the sample and the counts read the key columns only.

P2 ``blocked``: windows run per block of ``block_rows`` consecutive positions.
A window reaching ``h`` rows back sees them because the last ``h`` rows of each
block are also copied into the next block (a halo). Fills that must carry a
value across any number of blocks go through a per-block summary table.

Every block holds at most ``block_rows + h`` rows, whatever the key skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "row_id"
DEFAULT_BLOCK_ROWS = 1 << 20
_BLK, _HOME = "_blk", "_home"


def _cols(cols) -> list:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)


# Sampled keys for each range: a range then rarely holds twice its share.
SAMPLE_PER_RANGE = 32


def _ranged(df: DataFrame, order, ranges: int | None) -> DataFrame:
    """``df`` with ``_pid``, the range that a row's key falls into: at most ``ranges``
    (default: the session's shuffle partitions) and contiguous in ``order``."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(order)])
    sample = (df.select(key.alias("key")).orderBy(F.xxhash64("key"), "key")
                .limit(SAMPLE_PER_RANGE * ranges).agg(F.array_sort(F.collect_list("key")).alias("s")))
    places = F.transform(F.sequence(F.lit(1), F.lit(ranges)), lambda i: F.floor(i * F.size("s") / ranges).cast("int"))
    fine = F.array_distinct(F.filter(F.transform(places, lambda i: F.get("s", i)), lambda b: b.isNotNull()))
    step = max(1, int(ranges ** 0.5))
    bounds = sample.select(fine.alias("fine")).select(F.struct(
        "fine", F.filter("fine", lambda b, i: i % step == step - 1).alias("coarse")).alias("b"))

    def upto(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda n, b: n + (b <= F.col("_key")).cast("int"))
    # first among every step-th bound, then among the bounds of that step
    out = df.withColumn("_bounds", bounds.scalar()).withColumn("_key", key)
    out = out.withColumn("_coarse", upto(F.col("_bounds.coarse")) * step)
    found = F.col("_coarse") + upto(F.slice("_bounds.fine", F.col("_coarse") + 1, F.lit(step)))
    return out.withColumn("_pid", found).drop("_bounds", "_key", "_coarse")


def row_index(df: DataFrame, order, id_col: str = ROW_ID,
              partitions: int | None = None) -> DataFrame:
    """Append ``id_col`` = position of the row in ``order`` (0-based, dense).

    ``order`` is ascending. Rows that tie on all of it cannot be told apart and stay
    in one range: it should end in a key that makes it total."""
    order = _cols(order)
    ranged = _ranged(df, order, partitions)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    # one row per range
    return (ranged.withColumn("_at", inside).join(F.broadcast(offsets), "_pid")
                  .withColumn(id_col, (F.col("_off") + F.col("_at") - 1).cast("long"))
                  .drop("_pid", "_at", "_off"))


def running_weight(df: DataFrame, order, weight: str, out: str) -> DataFrame:
    """Append ``out`` = sum of ``weight`` over the rows up to and including this
    one in ``order`` (a total order): sums per range, then within."""
    order = _cols(order)
    ranged = _ranged(df, order, None)
    totals = ranged.groupBy("_pid").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    upto = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per range
    return (ranged.withColumn("_sum", F.sum(weight).over(upto)).join(F.broadcast(offsets), "_pid")
                  .withColumn(out, F.col("_off") + F.col("_sum")).drop("_pid", "_off", "_sum"))


def _ensure_index(df: DataFrame, order, partition_by, id_col: str) -> DataFrame:
    if id_col in df.columns:
        return df
    return row_index(df, [*_cols(partition_by), *_cols(order)], id_col)


def blocked(df: DataFrame, halo: int, block_rows: int = DEFAULT_BLOCK_ROWS,
            id_col: str = ROW_ID, ahead: int = 0) -> DataFrame:
    """Rows tagged with ``_blk``; the last ``halo`` rows of a block are repeated
    in the next block, and its first ``ahead`` rows in the one before, with ``_home``
    = false."""
    blk = F.floor(F.col(id_col) / F.lit(block_rows)).cast("long")
    if halo <= 0 and ahead <= 0:
        return df.withColumn(_BLK, blk).withColumn(_HOME, F.lit(True))
    # the row's own block, every later one whose first row lies up to halo rows after it,
    # and every earlier one whose last row lies up to ahead rows before it
    last = F.floor((F.col(id_col) + F.lit(halo)) / F.lit(block_rows)).cast("long")
    first = F.floor((F.col(id_col) - F.lit(ahead)) / F.lit(block_rows)).cast("long") if ahead > 0 else blk
    copies = df.withColumn("_own", blk).withColumn(_BLK, F.explode(F.sequence(first, last)))
    return copies.withColumn(_HOME, F.col(_BLK) == F.col("_own")).drop("_own")


# Fills need an order, not positions. A caller whose table has one row per date
# (and entity) may ask for date blocks of this many days, which saves the row
# index.
DEFAULT_BLOCK_DAYS = 1 << 10


def _fill(df: DataFrame, cols, order, partition_by, forward: bool,
          block_rows: int, id_col: str, one_row_per_date: bool) -> DataFrame:
    pb = _cols(partition_by)
    cols = _cols(cols)
    if one_row_per_date:
        (pos,) = _cols(order)
        indexed = df
        b = df.withColumn(_BLK, F.floor(F.unix_date(F.col(pos)) / DEFAULT_BLOCK_DAYS)
                          .cast("long"))
    else:
        indexed = _ensure_index(df, order, pb, id_col)
        pos = id_col
        b = blocked(indexed, 0, block_rows, id_col)
    w = Window.partitionBy(*pb, _BLK).orderBy(pos)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if forward \
        else w.rowsBetween(0, Window.unboundedFollowing)
    pick = F.last if forward else F.first
    by_pos = F.max_by if forward else F.min_by
    filled = b.select(*[F.coalesce(pick(F.col(c), ignorenulls=True).over(w), F.col(c)).alias(c)
                        if c in cols else F.col(c) for c in b.columns])
    # per (entity, block): the last (first) non-null value of each column. Taken
    # from the window output, which is already partitioned by (entity, block):
    # no extra shuffle, and both branches share the window's exchange.
    summary = filled.groupBy(*pb, _BLK).agg(*[
        by_pos(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_e_{c}")
        for c in cols])
    sw = Window.partitionBy(*pb).orderBy(_BLK)
    sw = sw.rowsBetween(Window.unboundedPreceding, -1) if forward \
        else sw.rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select(*pb, _BLK, *[pick(F.col(f"_e_{c}"), ignorenulls=True).over(sw)
                                         .alias(f"_carry_{c}") for c in cols])
    out = filled.join(carry, [*pb, _BLK], "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_carry_{c}")).alias(c) if c in cols
                        else F.col(c) for c in indexed.columns])


def forward_fill(df: DataFrame, cols, order, partition_by=None,
                 block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = ROW_ID,
                 one_row_per_date: bool = False) -> DataFrame:
    """Each NULL in ``cols`` takes the last non-null value before it in ``order``.

    ``one_row_per_date`` states that ``order`` is one date column without repeats
    per entity (e.g. a group key): blocks are then date ranges."""
    return _fill(df, cols, order, partition_by, True, block_rows, id_col, one_row_per_date)


def back_fill(df: DataFrame, cols, order, partition_by=None,
              block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = ROW_ID,
              one_row_per_date: bool = False) -> DataFrame:
    """Each NULL in ``cols`` takes the next non-null value after it in ``order``.

    ``one_row_per_date`` states that ``order`` is one date column without repeats
    per entity (e.g. a group key): blocks are then date ranges."""
    return _fill(df, cols, order, partition_by, False, block_rows, id_col, one_row_per_date)


def rolling_mean(df: DataFrame, cols, window: int, order, partition_by=None,
                 suffix: str = "_roll", backfill: bool = True,
                 block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = ROW_ID) -> DataFrame:
    """Mean of the last ``window`` rows; NULL unless all ``window`` values are
    present, then (optionally) back-filled. Rows never span ``partition_by`` groups."""
    pb = _cols(partition_by)
    cols = _cols(cols)
    indexed = _ensure_index(df, order, pb, id_col)
    b = blocked(indexed, window - 1, block_rows, id_col)
    w = Window.partitionBy(*pb, _BLK).orderBy(id_col).rowsBetween(-(window - 1), 0)
    rolled = b.select("*", *[F.when(F.count(F.col(c)).over(w) == window,
                                    F.avg(F.col(c)).over(w)).alias(f"{c}{suffix}")
                             for c in cols])
    rolled = rolled.where(F.col(_HOME)).drop(_BLK, _HOME)
    if backfill:
        rolled = back_fill(rolled, [f"{c}{suffix}" for c in cols], order, pb,
                           block_rows, id_col)
    return rolled


def sequence_windows(df: DataFrame, features, length: int, order, partition_by=None,
                     out: str = "x", block_rows: int = DEFAULT_BLOCK_ROWS,
                     id_col: str = ROW_ID, first_of: str | None = None) -> DataFrame:
    """Append ``out`` = array of the ``length`` previous rows' ``features``
    (oldest first); rows with fewer than ``length`` predecessors are dropped.
    The current row carries the label columns. ``first_of`` adds
    ``first_<col>`` = that column's value on the window's oldest row."""
    pb = _cols(partition_by)
    features = _cols(features)
    indexed = _ensure_index(df, order, pb, id_col)
    b = blocked(indexed, length, block_rows, id_col)
    w = Window.partitionBy(*pb, _BLK).orderBy(id_col).rowsBetween(-length, -1)
    extra = [F.col(first_of).alias("_k")] if first_of else []
    step = F.struct(F.array(*[F.col(c).cast("double") for c in features]).alias("_v"), *extra)
    seq = F.collect_list(step).over(w)  # the frame is ordered
    windowed = b.select("*", seq.alias("_seq")).where(F.col(_HOME) & (F.size("_seq") == length))
    if first_of:
        windowed = windowed.withColumn(f"first_{first_of}", F.col("_seq")[0]["_k"])
    return (windowed.withColumn(out, F.transform("_seq", lambda s: s["_v"]))
                    .drop("_seq", _BLK, _HOME))


def current_row(df: DataFrame, key: str = "date") -> DataFrame:
    """The row with the greatest ``key`` (one partial max per partition, then one merge)."""
    return df.select(F.max_by(F.struct(*df.columns), F.col(key)).alias("_r")).select("_r.*")


def first_k(df: DataFrame, k: int, order) -> DataFrame:
    """First ``k`` rows in ``order`` (top-k per partition, then a k-row merge)."""
    return df.orderBy(*_cols(order)).limit(k)
