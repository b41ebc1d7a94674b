"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets alone are split on another bit.

Whether a bucket splits depends only on the bytes and rows under its prefix, so all splits are found together: rows are summed by
a long prefix, the sums are summed again for each shorter prefix, and the oversized prefixes say how deep each cell
of the directory lies. Only DataFrame functions are used and only sums are shuffled beside the rows' keys and sizes.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import named, stored, table

#: Most bytes of text in a shard, and bits of a key's hash.
SHARD_BYTES, HASH_BITS = 64 << 20, 60
#: The limit of the second query.
SMALL = 40_000
#: Bits beyond those of evenly filled shards that one round looks at.
SLACK = 6


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, F.lit(HASH_BITS) - depth if isinstance(depth, Column) else F.lit(HASH_BITS - depth))


def _deepen(rows: DataFrame, h: str, low: int, high: int, limit: int) -> DataFrame:
    """rows (cell, h, bytes) with `depth`: the first of low … high bits at which the bucket of the row fits, else high + 1.

    cell: what a row's bucket already is apart from h; all its rows are of an oversized bucket of low - 1 bits.
    """
    cells = rows.groupBy("cell", _prefix(F.col(h), high).alias("at")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    up = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level")
    higher = cells.select("cell", "at", "bytes", "rows", up).withColumn("prefix", F.call_function("shiftright", "at", F.lit(high) - F.col("level")))
    over = higher.groupBy("cell", "level", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).where((F.col("bytes") > limit) & (F.col("rows") > 1))
    over = stored(over.select("cell", "level", "prefix"), "over")
    # Levels at which every prefix is oversized need no join; below them no prefix holds many cells.
    full = {r["level"]: r["n"] for r in over.where("cell = ''").groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    skip = low
    while low == 0 and skip <= high and full.get(skip, 0) == 1 << skip:
        skip += 1
    near = higher.where(F.col("level") >= skip).join(over, ["cell", "level", "prefix"], "left_semi").groupBy("cell", "at").agg(F.count(F.lit(1)).alias("more"))
    placed = rows.withColumn("at", _prefix(F.col(h), high)).join(near, ["cell", "at"], "left")
    return placed.withColumn("depth", F.lit(skip) + F.coalesce("more", F.lit(0)).cast("int")).drop("at", "more")


def assign(df: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = SHARD_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, bytes, shard and depth of each row, and the columns named in carry.

    shard is the bucket's prefix as a text of 0s and 1s ('' if everything fits one shard). No shard of more than one row exceeds
    `limit`; a row that alone exceeds it has a shard of its own. Null and empty texts have no bytes. Rows whose keys are equal (repeated rows, null
    keys) and exceed the limit together, after all 60 bits, are split on bits of a row's position ('.' and more bits in the name), so ties
    need no order. An empty table gives an empty one. Carried columns may have any names but those four.
    """
    size = F.octet_length("text") if size is None else size
    packed = F.struct(*(named(c) for c in carry)) if carry else F.lit(None).cast("int")
    slim = df.select(named(key).alias("key"), hash60(named(key)).alias("h"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"), F.monotonically_increasing_id().alias("row"), packed.alias("carried"))
    slim = stored(slim.select("*", hash60(F.col("row")).alias("h2")).drop("row"), "sizes").withColumn("cell", F.lit(""))
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    high = min(HASH_BITS, max(0, ceil(log2(max(total, 1) / limit))) + SLACK)
    out, low, part, h = None, 0, slim, "h"
    while True:
        part = _deepen(part, h, low, high, limit)
        bits = F.lpad(F.bin(_prefix(F.col(h), F.col("depth"))), F.col("depth"), "0")
        name = F.concat(F.when(F.lit(h == "h2"), F.concat("cell", F.lit("."))).otherwise(F.lit("")), F.when(F.col("depth") > 0, bits).otherwise(F.lit("")))
        done = part.where(F.col("depth") <= high).select(F.col("key").alias(key), "bytes", name.alias("shard"), F.when(F.lit(h == "h2"), F.col("depth") + HASH_BITS).otherwise(F.col("depth")).alias("depth"), "carried")
        out = done if out is None else out.unionByName(done)
        left = part.where(F.col("depth") > high)
        if h == "h2" and high == HASH_BITS or left.isEmpty():
            return out.select(named(key), "bytes", "shard", "depth", *(F.col("carried").getField(c).alias(c) for c in carry))
        whole = high == HASH_BITS
        seen = F.lpad(F.bin(_prefix(F.col("h"), high)), high, "0") if h == "h" else F.col("cell")
        part = stored(left.withColumn("cell", seen).drop("depth"), "left")
        h, low, high = ("h2", 1, HASH_BITS) if whole else (h, high + 1, HASH_BITS)


def write_shards(df: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", folder: str = "shard") -> None:
    """Writes df, all columns, as Parquet with a folder `<folder>=p<bits>` for each shard.

    The rows of a shard meet in one task, which its limit bounds. A column of df that is named like the folder is an error: Spark would
    read the folder's value in its place.
    """
    if folder in df.columns:
        raise ValueError(f"column {folder} clashes with the folders' name: pass another as folder")
    whole = df.select(named(key).alias("key"), F.struct(*(named(c) for c in df.columns)).alias("all"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    placed = assign(whole, "key", F.col("size"), limit, ("all",)).select("all.*", F.concat(F.lit("p"), "shard").alias(folder))
    placed.repartition(folder).write.partitionBy(folder).parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def small_shards(spark, sf_dir: str) -> DataFrame:
    """The same with shards of SMALL bytes, so that small tables split too."""
    return assign(table(spark, sf_dir, "documents"), limit=SMALL)


OP1_SQL = f"""
WITH rows AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents
), levels AS (SELECT unnest(range(0, {HASH_BITS + 1})) AS level),
sums AS (
  SELECT level, h >> ({HASH_BITS} - level) AS prefix, sum(bytes) AS bytes, count(*) AS n FROM rows, levels GROUP BY ALL
), placed AS (
  SELECT r.doc_id, r.bytes, r.h, min(s.level) AS depth FROM rows r, levels l, sums s
  WHERE s.level = l.level AND s.prefix = r.h >> ({HASH_BITS} - l.level) AND (s.bytes <= {SHARD_BYTES} OR s.n = 1) GROUP BY ALL
)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({HASH_BITS} - depth)), CAST(depth AS INT), '0') END AS shard, CAST(depth AS INT) AS depth FROM placed
"""
SMALL_SQL = OP1_SQL.replace(str(SHARD_BYTES), str(SMALL))
