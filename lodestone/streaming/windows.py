"""Structured Streaming over tables of events, and runs of it to the end of what is there."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at path, with their schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts and sums of value per window and key; rows later than `late` behind the newest are left out of closed windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with no pause of `gap` between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """The stream's result once it has taken in all that is there, kept as Parquet beside its checkpoint."""
    run = uuid.uuid4().hex
    out = f"{checkpoint}/{run}/out"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/{run}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def sliding(events: DataFrame, width: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts and sums of value per window of `width`, one beginning each `step`, and key. In append mode a window comes once it is closed:
    when its end is `late` behind the newest row; rows of closed windows are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """(key, first_id, then_id): rows of one stream with those of another that come after them within `within`; both (key, event_id, ts).

    The watermarks bound what the join keeps of either side.
    """
    a = first.select(F.col(key), F.col("event_id").alias("first_id"), F.col("ts").cast("timestamp").alias("a_ts")).withWatermark("a_ts", late)
    b = then.select(F.col(key).alias("b_key"), F.col("event_id").alias("then_id"), F.col("ts").cast("timestamp").alias("b_ts")).withWatermark("b_ts", late)
    near = (F.col(key) == F.col("b_key")) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"interval {within}"))
    return a.join(b, near).select(key, "first_id", "then_id")


class Feed:
    """A folder that a stream reads, filled page by page, and what the stream gives; the stream starts anew from its checkpoint for each page."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, f"{folder}/{uuid.uuid4().hex}", schema
        self.progress: list[dict] = []
        spark.createDataFrame([], schema).write.parquet(f"{self.folder}/in")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")

    def add(self, page: DataFrame) -> None:
        page.write.mode("append").parquet(f"{self.folder}/in")

    def run(self, stream: DataFrame, mode: str = "append", fail_after: int | None = None) -> None:
        """Takes in all that is there. A batch is written under its number, so one that is repeated after a loss replaces itself."""
        out = f"{self.folder}/out"

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if fail_after is not None and number >= fail_after:
                raise RuntimeError("lost on purpose")

        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress += [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]

    def result(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/out/batch=*")

    def late_rows(self) -> int:
        """Rows that came after their window was closed, as the state operators count them (after partial sums)."""
        return sum(op.get("numRowsDroppedByWatermark", 0) for p in self.progress for op in p.get("stateOperators", []))


def pages(df: DataFrame, by: Column, number: int) -> list[DataFrame]:
    """df in parts of equal width of a numeric column, in its order."""
    ends = df.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
    if ends["a"] is None:
        return [df]
    width = (float(ends["b"]) - float(ends["a"])) / number or 1.0
    page = F.least(F.floor((by - F.lit(float(ends["a"]))) / width), F.lit(number - 1))
    return [df.where(page == k) for k in range(number)]


def fed(df: DataFrame, by: Column, number: int, operator: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append") -> tuple[DataFrame, Feed]:
    """What an operator gives for df as a stream that comes in `number` pages, by time."""
    feed = Feed(df.sparkSession, folder, df.schema)
    schema = None
    for page in pages(df, by, number):
        feed.add(page)
        stream = operator(feed.stream())
        schema = stream.schema
        feed.run(stream, mode)
    return feed.result(schema), feed


def seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("double")


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one where that is unset and all of Spark is in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="lodestone-stream-")
    return found
