"""Distribution functions that neither Spark nor SQL has."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.streaming.windows import scratch

# The rational approximation of the error function by Abramowitz and Stegun, 7.1.26, right to 1.5e-7.
_P, _A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_sf(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, for z of 0 or more."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + _P * x)
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + a) * t
    return 0.5 * poly * F.exp(-x * x)


def sf_sql(z: str) -> str:
    """The same as SQL."""
    x = f"(({z}) / sqrt(2.0))"
    t = f"(1 / (1 + {_P} * {x}))"
    poly = "0.0"
    for a in reversed(_A):
        poly = f"(({poly} + {a}) * {t})"
    return f"(0.5 * {poly} * exp(-{x} * {x}))"


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """keys and a column for each point: exact percentiles with linear interpolation; nulls are left out.

    Counts of distinct values are dealt by ranges of key and value, so a key of very many values is spread over tasks; a value's place is what the
    ranges before its own hold and what comes before it there. The dealt counts are written to the shared folder, so both are of the same deal.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    named = counts.withColumn("_k", F.to_json(F.struct(*(F.col(k) for k in keys))) if keys else F.lit(""))  # null keys join too
    path = f"{scratch(spark)}/percentiles-{uuid.uuid4().hex}"
    named.repartitionByRange("_k", "_v").withColumn("_p", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sums = dealt.groupBy("_k", "_p").agg(F.sum("_c").alias("_s"))
    own = Window.partitionBy("_k")
    before = sums.select("_k", "_p", F.sum("_s").over(own).alias("_n"), (F.sum("_s").over(own.orderBy("_p")) - F.col("_s")).alias("_before"))
    placed = dealt.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_k", "_p").orderBy("_v"))).join(before, ["_k", "_p"]).withColumn("_upto", F.col("_upto") + F.col("_before"))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col("_v")))

    out = []
    for name, q in points.items():
        place = q * (F.col("_n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    found = placed.groupBy("_k", *keys).agg(*out)
    return found.drop("_k")
