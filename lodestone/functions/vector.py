"""Vector functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def similarity(cos: Column) -> Column:
    """1 / (1 + distance) of a cosine distance."""
    return 1 / (1 + F.greatest(F.lit(0.0), 1 - cos))


def parse_embedding(text: Column) -> Column:
    """A JSON array of numbers; null where it is anything else."""
    v = F.from_json(text, "array<double>")
    return F.when(text.rlike(r"^\s*\[\s*(-?\d+(\.\d+)?([eE][+-]?\d+)?\s*(,\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*)*)?\]\s*$"), v)


@F.pandas_udf(StringType())
def _printed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else ",".join("%.6f" % x for x in v))


def six_decimals(v: Column) -> Column:
    """The numbers with six decimals each, joined by commas; null numbers are left out.

    Rounded from the exact binary value, ties to even, as C and SQL engines print them. (F.format_string rounds the shortest decimal form, ties up.)
    """
    return _printed(F.filter(doubles(v), lambda x: x.isNotNull()))
