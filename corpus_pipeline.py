"""A training-data pipeline over `documents`: quality rules, near-dedup, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`, further columns included, whatever their names are. In every stage nulls in any
column, very long texts and an empty table are in order; each docstring says what becomes of null and empty texts and of repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, packing, pii, quality, simhash
from lodestone.llm.arrow import checkpoint_dir, named, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go: null and empty texts have no words and go, repeated rows are judged alike."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id.

    Null and empty texts are one group. Rows that repeat a doc_id and text count as one; rows without a doc_id stay.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none and stay, repeated rows go or stay alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gets pseudonyms, equal values equal ones; n_chars is that of the new text, null where it is null.

    Null and empty texts stay as they are, and so do all rows. A column `pii` of docs is kept.
    """
    done = pii.pseudonymise(docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), "text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, packed into sequences: null and empty texts are the end id alone, repeated rows are packed as often as they occur."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontamination), ("pii", pseudonyms), ("packing", best_fit)]
#: Trees, MinHash and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what lies between them goes to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
