"""Connected components of a link table by random contraction.

Every round each vertex joins the neighbour (or itself) of least random rank;
the links are carried over to these representatives. The expected number of
vertices falls by a constant factor a round, so long chains take a logarithmic
number of rounds. Minima are combined before the shuffle and the joins have a
shuffled table on both sides, so that Spark can split a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeris.llm.common import scratch_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every vertex of ``links`` (u, v); each row is one link,
    in either direction. Self links and repeats do not matter; no links, no rows."""
    pairs = links.select("u", "v").where(F.col("u") != F.col("v"))
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = scratch_table(both.distinct(), "links")
    steps = []
    while not both.isEmpty():
        rank = F.xxhash64(F.col("v"), F.lit(len(steps)))
        own = F.struct(F.xxhash64(F.col("u"), F.lit(len(steps))), F.col("u").alias("v"))
        best = both.groupBy("u").agg(F.min(F.struct(rank.alias("col1"), "v")).alias("best"))
        step = best.select(F.col("u").alias("node"), F.least(own, F.col("best"))["v"].alias("root"))
        steps.append(scratch_table(step, "contraction"))
        left = steps[-1].select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = steps[-1].select(F.col("node").alias("v"), F.col("root").alias("rv"))
        both = (both.join(left, "u").join(right, "v").where(F.col("ru") != F.col("rv"))
                    .select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        both = scratch_table(both, "links")
    if not steps:
        return both.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("after"))
        found = (found.join(nxt, "root", "left")
                      .select("node", F.coalesce("after", "root").alias("root")))
    return found
