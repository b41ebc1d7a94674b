"""Chunkers as column expressions and table functions over documents (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def fixed_windows(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_index from 0, content): windows of `size` characters of the collapsed text, each start that lies inside it."""
    step = max(1, size - overlap)
    whole = docs.select("doc_id", T.collapse(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    starts = F.sequence(F.lit(1), F.length("t"), F.lit(step))
    return whole.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.substring("t", s, F.lit(size)))).alias("chunk_index", "content"))
