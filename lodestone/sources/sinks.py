"""Writers: JSON lines, generations of an index, appends that can be taken up again, text expositions of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.generations import Folder


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_generation(df: DataFrame, path: str, generation: str) -> None:
    """Adds one generation as a partition of its own; a repeated call replaces it."""
    df.withColumn("generation_id", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation_id").parquet(path)


def append_missing(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key path does not hold yet and returns their number, so a run can be repeated."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    new = df.join(spark.read.parquet(path).select(*key), key, "left_anti") if there else df
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def exposition(metrics: DataFrame) -> DataFrame:
    """(line): metrics (name, label, value) in the text form that scrapers read."""
    return metrics.select(F.concat(F.col("name"), F.lit('{label="'), F.col("label"), F.lit('"} '), F.col("value").cast("string")).alias("line"))


def snapshot(df: DataFrame, path: str, version: int, keep: int = 3) -> DataFrame:
    """Writes version as a partition, deletes the folders of all but the newest `keep` versions and returns what is left."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
    spark = df.sparkSession
    folder = Folder(spark, path)
    there = sorted(int(n.removeprefix("version=")) for n in folder.names() if n.startswith("version="))
    for old in there[:-keep]:
        folder.delete(f"version={old}")
    return spark.read.parquet(path)


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, if it has no more rows than that; a report that would leave some out is an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows: write them as a table")
    return df


def markdown_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table: summaries of a few rows, which the driver formats."""
    rows = _few(df, most).collect()
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(str(v) for v in r)} |" for r in rows)])


def write_xlsx(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A result as a sheet, for people: at most what a sheet holds. Needs openpyxl, which is asked for here alone."""
    import importlib.util

    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("write_xlsx needs openpyxl")
    _few(df, most).toPandas().to_excel(path, index=False)
