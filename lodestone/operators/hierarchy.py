"""Trees given by parents: roots and depths of all nodes in rounds that grow with the logarithm of the depth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.streaming.windows import scratch


def rooted(nodes: DataFrame) -> DataFrame:
    """(id, parent, root, depth) of nodes (id, parent); root and depth are null where a cycle is above.

    A node whose parent is null or is not among the nodes is a root, of depth 0; ids are taken once. Each node points to an ancestor, at first its
    parent, and in each round to that one's ancestor, so distances double. Nodes that have reached a root take no further part; a
    parent of very many children is one row on its side of the join, and the children's side can be split. Each round is written to the shared folder. Who
    has not reached a root after more rounds than the number of nodes has bits never will: that is a cycle.
    """
    spark = nodes.sparkSession
    folder = f"{scratch(spark)}/tree-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    own = nodes.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    ids = own.select(F.col("id").alias("known"))
    start = own.join(ids, F.col("parent") == F.col("known"), "left")
    top = F.col("known").isNull()
    state = start.select("id", F.when(~top, F.col("parent")).alias("parent"), F.when(top, F.col("id")).otherwise(F.col("parent")).alias("at"), F.when(top, 0).otherwise(1).cast("long").alias("far"), top.alias("done"))
    state = stored(state, "0")
    n = state.count()
    left, k = state.where("not done").count(), 0
    while left and k <= n.bit_length():
        k += 1
        there = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"), F.col("done").alias("over"))
        moved = state.where("not done").join(there, "at").select("id", "parent", F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far"), F.col("over").alias("done"))
        state = stored(state.where("done").unionByName(moved), str(k))
        left = state.where("not done").count()
    return state.select("id", "parent", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("far")).alias("depth"))
