"""Connected components of a graph given as a DataFrame of edges, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import stored


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each node that is not the least of its component, with that least node. edges: columns u, v of one type.

    Alternates large-star and small-star steps, each an aggregation that combines before its shuffle and a join whose large
    keys AQE can split, so a node with very many links is no hot spot. Each round is written to the shared
    checkpoint folder. Loops and repeated edges do no harm; no edges give no rows. Rounds grow with the logarithm of the longest chain; a graph
    that has not settled after `most_rounds` raises, nothing is cut short.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            return now
        # Large star: all larger neighbours of a node get the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _mins(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: all smaller neighbours of a node, and the node, get the least of them.
        large = stored(large, "large")
        least = _mins(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "small")
        new = _mark(now)
        if new == mark:
            return now
        mark = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).first()
    return row["n"], row["x"], row["s"]
