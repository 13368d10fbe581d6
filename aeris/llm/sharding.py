"""Sharding by minimax contiguous partition (operator 3).

Documents with equal texts must share a shard, so the atoms that may not be cut
are sets of equal texts: an atom holds every text whose MD5 starts with the same
``ATOM_BITS`` bits. Their sizes, ordered by hash, are at most 2^16 numbers
whatever the corpus. One expression over that list finds the least capacity for
which filling shard after shard, each until the next atom would not fit, needs
no more than the given number of shards (binary search, greedy check). Within that
capacity a second search evens the shards out: the least load at which a shard may
be closed early and the shards still suffice. So an atom that holds a third of all
bytes sets the capacity, and the other shards share the rest. The documents then
look up their shard by atom.

The sums are combined before the shuffle, so a text that a third of the rows
share is a few partial sums. Slots are positions in a distributed sort, offset
by the shard's first position; no task holds a whole shard.

Defined results: a null text has size 1, the checksum of no bytes, and shares
its shard with the other null texts; an empty table gives no rows; repeated rows
are placed as often as they occur, ties in the slot order are broken by input
position; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import scratch_table, table
from aeris.operators.ordered import row_index

SHARDS = 16
ATOM_BITS = 16
SEARCH_STEPS = 64


def greedy_cuts(sizes: Column, capacity: Column, enough: Column, shards: int) -> Column:
    """struct(cuts, fits): the first atom index of every shard after the first when
    each is filled until it holds ``enough`` or the next atom would exceed ``capacity``;
    ``fits`` if ``shards`` suffice."""
    start = F.struct(F.lit(0).cast("long").alias("load"),
                     F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("i"))

    def put(state: Column, size: Column) -> Column:
        full = (state["load"] + size > capacity) | (state["load"] >= enough)
        room = F.size(state["cuts"]) < shards
        return F.struct(
            F.when(full, size).otherwise(state["load"] + size).alias("load"),
            F.when(full & room, F.concat(state["cuts"], F.array(state["i"]))).otherwise(state["cuts"])
             .alias("cuts"),
            (state["i"] + 1).alias("i"))
    return F.aggregate(sizes, start, put, lambda s: F.struct(
        s["cuts"].alias("cuts"), (F.size(s["cuts"]) < shards).alias("fits")))


def minimax_cuts(atoms: DataFrame, shards: int) -> DataFrame:
    """One row (capacity, cuts) for (atom, size); at most 2^ATOM_BITS atoms."""
    one = atoms.agg(F.array_sort(F.collect_list(F.struct("atom", "size"))).alias("atoms"))
    one = scratch_table(one.select(F.col("atoms.atom").alias("atom"), F.col("atoms.size").alias("size"),
                                   F.coalesce(F.array_max("atoms.size"), F.lit(0)).alias("lo"),
                                   F.aggregate("atoms.size", F.lit(0).cast("long"), lambda a, x: a + x)
                                   .alias("hi")), "atoms")

    def least(lo: Column, hi: Column, fits) -> Column:
        """The least number of [lo, hi] that fits; ``hi`` does."""
        def halve(state: Column, _: Column) -> Column:
            middle = state["lo"] + F.floor((state["hi"] - state["lo"]) / 2).cast("long")
            tried = F.array(F.struct(middle.alias("middle"), fits(middle).alias("fits")))
            narrowed = F.transform(tried, lambda m: F.struct(
                F.when(m["fits"], state["lo"]).otherwise(m["middle"] + 1).alias("lo"),
                F.when(m["fits"], m["middle"]).otherwise(state["hi"]).alias("hi")))[0]
            return F.when(state["lo"] >= state["hi"], state).otherwise(narrowed)
        return F.aggregate(F.sequence(F.lit(1), F.lit(SEARCH_STEPS)), F.struct(lo.alias("lo"), hi.alias("hi")),
                           halve, lambda s: s["hi"])

    def cut(capacity: Column, enough: Column) -> Column:
        return greedy_cuts(F.col("size"), capacity, enough, shards)
    found = one.withColumn("capacity", least(
        F.greatest("lo", F.ceil(F.col("hi") / shards).cast("long")), F.col("hi"),
        lambda c: cut(c, c + 1)["fits"]))
    found = scratch_table(found.select("atom", "size", "capacity"), "capacity")
    found = scratch_table(found.withColumn("enough", least(
        F.lit(1).cast("long"), F.col("capacity") + 1, lambda e: cut(F.col("capacity"), e)["fits"])), "enough")
    return found.select("capacity", F.transform(
        cut(F.col("capacity"), F.col("enough"))["cuts"], lambda i: F.col("atom")[i]).alias("cuts"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(content) + F.lit(1)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.conv(F.substring(F.md5(content), 1, ATOM_BITS // 4), 16, 10).cast("int").alias("atom"))
    rows = scratch_table(rows.withColumn("_at", F.monotonically_increasing_id()), "sizes")
    cuts = scratch_table(minimax_cuts(rows.groupBy("atom").agg(F.sum("size").alias("size")), shards), "cuts")
    # one row of at most ``shards`` numbers
    placed = rows.withColumn("cuts", cuts.select("cuts").scalar())
    placed = placed.withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("atom"))).cast("int"))
    indexed = row_index(placed.drop("cuts"), ["shard", "doc_id", "text_crc32", "_at"], "_row")
    firsts = indexed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return indexed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def op3_minimax_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
bits AS (
  SELECT list(c ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(0 AS BIGINT))),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
octets AS (
  SELECT n, doc_id, t, list_transform(list_filter(string_split(regexp_replace(hex(encode(t)), '(..)', '\1,', 'g'), ','),
    lambda x: x <> ''), lambda x: CAST('0x' || x AS BIGINT)) AS o FROM d),
sized AS (
  SELECT n, doc_id, len(o) + 1 AS size, CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) AS atom,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), o),
      lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM octets, bits),
atoms AS (SELECT atom, sum(size) AS size FROM sized GROUP BY atom),
sums AS (SELECT atom, size, CAST(sum(size) OVER (ORDER BY atom) AS BIGINT) AS upto FROM atoms),
ends AS (SELECT list(upto ORDER BY upto) AS p, max(upto) AS total,
    CAST(greatest(max(size), ceil(max(upto) / 16.0)) AS BIGINT) AS least FROM sums),
search AS (
  SELECT least AS lo, total AS hi, CAST(0 AS BIGINT) AS at, 0 AS k FROM ends
  UNION ALL
  SELECT CASE WHEN stop < total AND k >= 15 THEN (lo + hi) // 2 + 1 ELSE lo END,
         CASE WHEN stop = total THEN (lo + hi) // 2 ELSE hi END,
         CASE WHEN stop = total OR k >= 15 THEN 0 ELSE stop END,
         CASE WHEN stop = total OR k >= 15 THEN 0 ELSE k + 1 END
  FROM (SELECT s.*, total, list_max(list_filter(p, lambda x: x <= s.at + (s.lo + s.hi) // 2)) AS stop
        FROM search s, ends WHERE s.lo < s.hi)),
capacity AS (SELECT min(hi) AS c FROM search),
even AS (
  SELECT CAST(1 AS BIGINT) AS lo, c + 1 AS hi, CAST(0 AS BIGINT) AS at, 0 AS k FROM capacity
  UNION ALL
  SELECT CASE WHEN stop < total AND k >= 15 THEN (lo + hi) // 2 + 1 ELSE lo END,
         CASE WHEN stop = total THEN (lo + hi) // 2 ELSE hi END,
         CASE WHEN stop = total OR k >= 15 THEN 0 ELSE stop END,
         CASE WHEN stop = total OR k >= 15 THEN 0 ELSE k + 1 END
  FROM (SELECT s.*, total, least(list_max(list_filter(p, lambda x: x <= s.at + c)),
          coalesce(list_min(list_filter(p, lambda x: x >= s.at + (s.lo + s.hi) // 2)), total)) AS stop
        FROM even s, ends, capacity WHERE s.lo < s.hi)),
enough AS (SELECT min(hi) AS e FROM even),
cuts AS (
  SELECT least(list_max(list_filter(p, lambda x: x <= c)), coalesce(list_min(list_filter(p, lambda x: x >= e)), total)) AS cut,
         1 AS k FROM ends, capacity, enough
  UNION ALL
  SELECT least(list_max(list_filter(p, lambda x: x <= cut + c)),
           coalesce(list_min(list_filter(p, lambda x: x >= cut + e)), total)), k + 1
  FROM cuts, ends, capacity, enough WHERE cut < total AND k < 15),
placed AS (
  SELECT n, doc_id, sized.size, crc, (SELECT count(*) FROM cuts WHERE cut < upto) AS shard
  FROM sized JOIN sums USING (atom))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, n) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
