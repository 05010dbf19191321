"""Connected components by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.)
Every step is a minimum per node (combined before its shuffle) and a join of
the edges with it; a hub with a third of all edges is split by AQE's skew
join. Edges are written to the shared folder after each round and never
collected; a round reports two numbers to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.llm.common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    joined = both.where("v > u").join(least, F.col("u") == F.col("c"))
    return joined.select(F.col("v").alias("u"), F.least("m", "c").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    joined = down.join(least, F.col("u") == F.col("c")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any two comparable columns -> (node, root), root the least node.

    Nodes are those that occur in an edge; loops, repeated edges and an empty
    table are fine (an empty table gives no rows).
    """
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        larger = _large_star(now).where("u != v").distinct()
        after = materialise(_small_star(larger).where("u != v").distinct(), "edges")
        seen, state = state, _state(after)
        discard(now.sparkSession, now)
        now = after
        if seen == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
