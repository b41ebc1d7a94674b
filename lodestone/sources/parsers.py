"""Parsers and readers: blocks of plain and Markdown texts, JSON-lines data sets, corpus manifests, file kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# First bytes of file kinds, as hexadecimal digits.
MAGIC = {
    "25504446": "application/pdf", "504B0304": "application/zip", "89504E47": "image/png", "FFD8FF": "image/jpeg", "D0CF11E0": "application/msword", "4D5A": "application/x-msdownload", "7F454C46": "application/x-executable",
    "3C3F786D": "application/xml",
}


def mime(content: Column, name: Column) -> Column:
    """By first bytes, else by the name's ending, else plain text."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lit(False), F.lit(""))
    for digits, kind in MAGIC.items():
        out = out.when(head.startswith(digits), kind)
    for end, kind in (("md", "text/markdown"), ("html", "text/html"), ("json", "application/json"), ("csv", "text/csv")):
        out = out.when(F.lower(name).endswith(f".{end}"), kind)
    return out.otherwise("text/plain")


def plain_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_index, content): paragraphs between empty lines."""
    parts = F.filter(F.split("text", r"\n\s*\n"), lambda s: F.trim(s) != "")
    return docs.select("doc_id", F.posexplode(F.transform(parts, lambda t: F.trim(t))).alias("block_index", "content"))


def markdown_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, level, content, section_path): each line with its kind and the headings above it."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    by = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    inside = (F.sum(fence.cast("int")).over(by) - fence.cast("int")) % 2 == 1
    kind = (
        F.when(fence | inside, "code").when(F.col("line").rlike(r"^#{1,6}\s+\S"), "heading").when(F.col("line").rlike(r"^\s*\|?[\s:|-]*-{3,}[\s:|-]*\|?\s*$") & F.col("line").contains("|"), "separator")
        .when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table").when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list").when(F.col("line").rlike(r"^\s*>"), "quote").when(F.trim("line") == "", "blank").otherwise("paragraph")
    )
    typed = lines.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1))))
    title = F.trim(F.regexp_replace("line", "^#+", ""))
    for k in range(1, 7):
        # A heading of a higher level ends those below it.
        typed = typed.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, title).when(F.col("level") < k, F.lit("")), ignorenulls=True).over(by))
    path = F.array_join(F.filter(F.array(*(F.col(f"_h{k}") for k in range(1, 7))), lambda h: h.isNotNull() & (h != "")), " > ")
    return typed.where("kind not in ('blank', 'separator')").select("doc_id", "line_no", "kind", "level", F.col("line").alias("content"), path.alias("section_path"))


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A JSON-lines data set with the column `errors`: which of the required columns a row lacks."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("errors", F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda e: e.isNotNull()))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, n_chars, checksum) of each text file below path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("path"), F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1).alias("title"), F.length("value").alias("n_chars"), F.sha2("value", 256).alias("checksum"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed or same."""
    both = old.select("path", F.col("checksum").alias("a")).join(new.select("path", F.col("checksum").alias("b")), "path", "full")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


def layout_blocks(pages: DataFrame, width: float = 1000.0) -> DataFrame:
    """(doc_id, block_index, kind, content, x0, y0, x1, y1) from `content`, the JSON list of a layout service: bounding boxes scaled to 0 … 1."""
    items = F.from_json("content", "array<struct<type:string,text:string,text_level:int,page_idx:int,bbox:array<double>>>")
    rows = pages.select("doc_id", F.posexplode(items).alias("block_index", "b"))
    kind = F.when(F.col("b.text_level").isNotNull() & (F.col("b.text_level") > 0), "heading").when(F.col("b.type") == "table", "table").otherwise("paragraph")
    box = [F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get("b.bbox", F.lit(k)) / width)), 4).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.where(F.trim("b.text") != "").select("doc_id", "block_index", kind.alias("kind"), F.trim("b.text").alias("content"), *box)


def pdf_texts(files: DataFrame) -> DataFrame:
    """(path, text, error) of files as Spark's binaryFile source gives them; pages that can't be read have an error, other files a null text.

    Needs pypdf in the executors' environment, which is asked for in the tasks alone.
    """

    def read(batches):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    if PdfReader is None:
                        raise RuntimeError("pypdf is not there")
                    out.append((path, "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages), None))
                except Exception as e:  # whatever a broken file makes the reader raise
                    out.append((path, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")
