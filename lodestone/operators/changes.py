"""Change data: version diffs, reconciliation, merges and pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(logical_key, kind): unchanged, moved, modified or added for each new chunk, deleted for old ones whose hash is gone.

    A hash that is anywhere in the old version makes a chunk moved before its key can make it modified; so the old
    side of a modified chunk is listed as deleted too. Both: logical_key, chunk_hash.
    """
    was = old.select("logical_key", F.col("chunk_hash").alias("old_hash"))
    hashes = old.select("chunk_hash").distinct().withColumn("seen", F.lit(True))
    joined = new.join(was, "logical_key", "left").join(hashes, "chunk_hash", "left")
    kind = F.when(F.col("old_hash") == F.col("chunk_hash"), "unchanged").when(F.col("seen"), "moved").when(F.col("old_hash").isNotNull(), "modified").otherwise("added")
    deleted = old.join(new.select("chunk_hash").distinct(), "chunk_hash", "left_anti").select("logical_key", F.lit("deleted").alias("kind"))
    return joined.select("logical_key", kind.alias("kind")).unionByName(deleted)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in both, only left and only right."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("orphans"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows put in place of those of the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)
