"""Queries of users' own functions, of sources and of sinks: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import extend as E
from lodestone.operators import changes as D
from lodestone.plans import registry as S
from lodestone.plans.registry import query, table
from lodestone.sources import observations as O
from lodestone.sources import parsers, sinks
from lodestone.streaming import windows as W


def _path(spark) -> str:
    return f"{W.scratch(spark)}/{uuid.uuid4().hex}"


@query("user_scalar", "SELECT doc_id, length(text) * 2 + 1 AS score FROM documents WHERE text IS NOT NULL")
def user_scalar(spark, d):
    """A user's scoring function over Arrow batches."""
    score = E.scalar(lambda t: t.str.len() * 2 + 1, "long")
    return table(spark, d, "documents").where("text is not null").select("doc_id", score("text").alias("score"))


@query("user_aggregate", "SELECT label, round(max(vec_id) - median(vec_id), 4) AS spread FROM embeddings GROUP BY ALL")
def user_aggregate(spark, d):
    """A user's statistic of a group."""
    spread = E.aggregate(lambda v: float(v.max() - v.median()), "double")
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(spread(F.col("vec_id")), 4).alias("spread"))


@query("user_table_function", "SELECT item_id, CAST(n AS INT) AS n, word FROM (SELECT item_id, unnest(range(0, len(w))) AS n, unnest(w) AS word FROM (SELECT item_id, list_slice(regexp_extract_all(lower(text), '[a-z]+'), 1, 4) AS w FROM benchmark))")
def user_table_function(spark, d):
    """A user's chunker as an SQL table function."""

    def first_words(text):
        import re

        yield from enumerate(re.findall("[a-z]+", (text or "").lower())[:4])

    E.table_function(spark, "first_words", first_words, "n int, word string")
    table(spark, d, "benchmark").createOrReplaceTempView("lodestone_benchmark")
    return spark.sql("SELECT b.item_id, f.n, f.word FROM lodestone_benchmark b, LATERAL first_words(b.text) f")


_SEEN = "event_id long, user_id long, event_type string, value double"


def _service(spark, d, pages: int) -> tuple[str, list]:
    """A store of a service and the pages, by time, that it is going to give."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return _path(spark), [p.drop("ts") for p in W.pages(e, W.seconds("ts"), pages)]


@query("observation_source", "SELECT 'trace-' || user_id % 7 AS trace_id, count(*) AS n, count_if(event_type = 'error') AS errors, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def observation_source(spark, d):
    """SRC15: a service's store of events is read page by page through the data source interface, a task a page."""
    store, pages = _service(spark, d, 5)
    for k, page in enumerate(pages):
        page.write.json(f"{store}/page-{k:06d}")
    O.register(spark)
    o = spark.read.format("observations").schema(_SEEN).option("path", store).load()
    return o.groupBy(F.concat(F.lit("trace-"), F.col("user_id") % 7).alias("trace_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("total"))


@query("online_scores", "SELECT event_id, round(value * 2, 4) AS score FROM events WHERE event_type <> 'error' AND value >= 5")
def online_scores(spark, d):
    """STR4: a stream scores what a service gives, two pages after each start, and writes each score once."""
    store, pages = _service(spark, d, 6)
    O.register(spark)
    for k, page in enumerate(pages):
        page.write.json(f"{store}/page-{k:06d}")
        if k % 2:
            seen = spark.readStream.format("observations").schema(_SEEN).option("path", store).load()
            scored = seen.where("event_type <> 'error' and value >= 5").select("event_id", F.round(F.col("value") * 2, 4).alias("score"))
            scored.writeStream.format("observations").option("path", f"{store}/out").option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, score double").json(f"{store}/out/scores").select("event_id", "score")


#: What a layout service says of each page's first words: a title, a paragraph, a table, and a block without text; every ninth answer is broken.
_LAYOUT = S.Derived(
    "SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'broken' WHEN doc_id % 9 = 5 THEN '[]' ELSE '[' || chr(123) || '\"type\":\"text\",\"text\":\"Title ' || doc_id || ' \",\"text_level\":1,\"page_idx\":0,\"bbox\":[0,0,' || (doc_id % 1500) || ',100]' || chr(125) || ',' || chr(123) || '\"type\":\"text\",\"text\":\" ' || lang || '\",\"page_idx\":0,\"bbox\":[10,120,1200,300]' || chr(125) "
    "|| ',' || chr(123) || '\"type\":\"table\",\"text\":\"|' || source || '|\",\"page_idx\":1,\"bbox\":[-5,0,100,50]' || chr(125) || ',' || chr(123) || '\"type\":\"text\",\"text\":\" \",\"page_idx\":1' || chr(125) || ']' END AS content FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"
)
_BOX = "SELECT doc_id, {} AS block_index, '{}' AS kind, {} AS content, CAST({} AS DOUBLE) AS x0, CAST({} AS DOUBLE) AS y0, CAST({} AS DOUBLE) AS x1, CAST({} AS DOUBLE) AS y1 FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id % 9 NOT IN (4, 5)"


@query(
    "layout_blocks",
    " UNION ALL ".join(_BOX.format(*x) for x in ((0, "heading", "'Title ' || doc_id", "0", "0", "round(least(1.0, doc_id % 1500 / 1000), 4)", "0.1"), (1, "paragraph", "lang", "0.01", "0.12", "1", "0.3"), (2, "table", "'|' || source || '|'", "0", "0", "0.1", "0.05"))),
)
def layout_blocks(spark, d):
    """SRC6: blocks of a layout service's JSON; the SQL makes them from the columns that went into it."""
    return parsers.layout_blocks(_LAYOUT.df(spark, d))


@query("parser_fallback", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'none' WHEN contains(text, '|') THEN 'table' ELSE 'plain' END AS parser FROM documents")
def parser_fallback(spark, d):
    """SRC5: the first parser's result where it has one, else the next one's."""
    first = F.when(F.col("text").contains("|"), "table")
    second = F.when(F.trim("text") != "", "plain")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.trim("text") != "", first), second, F.lit("none")).alias("parser"))


#: Each document's line in a data set of cases; some lack a field or are no JSON.
_LINES = S.Derived(
    "SELECT doc_id AS n, CASE doc_id % 6 WHEN 0 THEN 'no json ' || doc_id WHEN 1 THEN chr(123) || '\"id\":\"' || doc_id || '\"' || chr(125) WHEN 2 THEN chr(123) || '\"id\":null,\"question\":\"' || lang || '\",\"expectedTerms\":[]' || chr(125) ELSE chr(123) || '\"id\":\"' || doc_id || '\",\"question\":\"' || lang || '?\",\"expectedTerms\":[\"' || source || '\"]' || chr(125) END AS line FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"
)


@query("dataset_validation", "SELECT doc_id AS n, CASE doc_id % 6 WHEN 0 THEN 'id,question' WHEN 1 THEN 'question' WHEN 2 THEN 'id' ELSE '' END AS errors FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def dataset_validation(spark, d):
    """SRC9: lines of a data set with what each lacks, read through files."""
    path = _path(spark)
    _LINES.df(spark, d).select(F.concat(F.col("n").cast("string"), F.lit("\t"), "line").alias("value")).write.text(path)
    rows = spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("n"), F.from_json(F.split_part("value", F.lit("\t"), F.lit(2)), "id string, question string, expectedTerms array<string>").alias("x"))
    need = F.array(*(F.when(F.col("x").isNull() | F.col("x")[c].isNull(), F.lit(c)) for c in ("id", "question")))
    return rows.select("n", F.array_join(F.filter(need, lambda e: e.isNotNull()), ",").alias("errors"))


@query("manifest_changes", "SELECT change, count(*) AS files FROM (SELECT CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL) b USING (doc_id)) GROUP BY ALL")
def manifest_changes(spark, d):
    """SRC10 and SRC11: two manifests of paths and checksums against each other."""
    docs = table(spark, d, "documents").where("text is not null")
    old = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("checksum"))
    new = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("checksum"))
    return parsers.manifest_diff(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


@query("object_store", "SELECT sha256(text) AS object_key, count(*) AS refs, max(length(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def object_store(spark, d):
    """SRC16: objects by their checksum, written once each, read back and checked."""
    path = _path(spark)
    docs = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("object_key"), "text")
    docs.dropDuplicates(["object_key"]).write.parquet(path)
    back = spark.read.parquet(path).where(F.sha2("text", 256) == F.col("object_key")).select("object_key", F.length("text").alias("n"))
    return docs.groupBy("object_key").agg(F.count(F.lit(1)).alias("refs")).join(back, "object_key").select("object_key", "refs", "n")


@query("index_ids", "SELECT label AS generation, count(*) AS ids, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY ALL")
def index_ids(spark, d):
    """SRC17: the ids of an index, without its vectors."""
    return table(spark, d, "embeddings").select("vec_id", "label").groupBy(F.col("label").alias("generation")).agg(F.count(F.lit(1)).alias("ids"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("jsonl_round_trip", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE lang IS NOT NULL")
def jsonl_round_trip(spark, d):
    """SNK1."""
    path = _path(spark)
    sinks.write_jsonl(table(spark, d, "documents").where("lang is not null").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("report_manifest", "SELECT section, rows, '# ' || section || chr(10) || rows || ' documents' AS markdown FROM (SELECT lang AS section, count(*) AS rows FROM documents GROUP BY ALL)")
def report_manifest(spark, d):
    """SNK2: the sections of a report, from aggregates."""
    g = table(spark, d, "documents").groupBy(F.col("lang").alias("section")).agg(F.count(F.lit(1)).alias("rows"))
    return g.select("section", "rows", F.concat(F.lit("# "), "section", F.lit("\n"), F.col("rows").cast("string"), F.lit(" documents")).alias("markdown"))


@query("ledger_append", "SELECT CAST(ts AS DATE) AS day, count(*) AS rows, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def ledger_append(spark, d):
    """SNK3 and SNK7: a ledger that is appended to by key; a second run adds nothing."""
    path = _path(spark)
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    sinks.append_missing(e.where("event_id % 2 = 0"), path, ["event_id"])
    sinks.append_missing(e, path, ["event_id"])
    sinks.append_missing(e, path, ["event_id"])
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@query("vector_sync", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 9")
def vector_sync(spark, d):
    """SNK4: rows of the same key replaced, ids that are gone deleted."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    new = v.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    return D.upsert(v, new, ["vec_id"]).join(v.where("vec_id % 10 <> 9").select("vec_id"), "vec_id", "left_semi")


@query("generation_write", "SELECT 'G00' || (1 + vec_id % 2) AS generation_id, count(*) AS n FROM embeddings GROUP BY ALL")
def generation_write(spark, d):
    """SNK5: generations as partitions; a generation that is written again replaces itself."""
    path = _path(spark)
    v = table(spark, d, "embeddings").select("vec_id", "label")
    for g, part in (("G001", v), ("G001", v.where("vec_id % 2 = 0")), ("G002", v.where("vec_id % 2 = 1"))):
        sinks.write_generation(part, path, g)
    return spark.read.parquet(path).groupBy(F.col("generation_id").cast("string").alias("generation_id")).agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_prune", "SELECT CAST(v AS INT) AS version, count(*) AS n FROM embeddings, range(2, 5) t(v) WHERE vec_id % (v + 1) = 0 GROUP BY ALL")
def snapshot_prune(spark, d):
    """SNK6: of five snapshots the newest three are there."""
    path = _path(spark)
    v = table(spark, d, "embeddings").select("vec_id")
    out = None
    for k in range(5):
        out = sinks.snapshot(v.where(F.col("vec_id") % (k + 1) == 0), path, k)
    return out.groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("metric_exposition", "SELECT event_type || '_total{label=\"' || (user_id % 3) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 3")
def metric_exposition(spark, d):
    """SNK8."""
    m = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("k")).agg(F.count(F.lit(1)).alias("value"))
    return sinks.exposition(m.select(F.concat("event_type", F.lit("_total")).alias("name"), F.col("k").cast("string").alias("label"), "value"))


@query("audit_flush", "SELECT event_type AS action, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL")
def audit_flush(spark, d):
    """SNK9: a stream of audit rows flushed batch by batch."""
    rows = W.read(spark, f"{d}/events.parquet").where("event_type in ('error', 'signup')").select(F.col("event_type").alias("action"), "event_id")
    return W.drained(rows, "append", W.scratch(spark)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
