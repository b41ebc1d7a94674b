"""Shared plumbing for operators that run Python over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with a function of one batch that yields batches of `schema`. Columns may have any names, dots included, which mapInArrow can't take."""
    names, given = df.columns, schema.names if isinstance(schema, StructType) else None
    plain = all(c.isidentifier() for c in names)
    if not plain:
        df = df.toDF(*(f"c{k}" for k in range(len(names))))
    if given:
        schema = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch if plain else batch.rename_columns(names)):
                    yield out.rename_columns(schema.names) if given else out

    done = df.mapInArrow(run, schema)
    return done.toDF(*given) if given else done


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again: into spark.checkpoint.dir, which all executors share, or into a temporary
    folder of this machine where that is unset and Spark is local, as in tests. Cuts the lineage; a lost executor costs a reread."""
    return checkpoint_dir(df.sparkSession) and df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which takes less room than a checkpoint for many rows of numbers."""
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; set for local sessions that have none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if found is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        sc.setCheckpointDir(found)
    return found or "set"


def named(column: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
