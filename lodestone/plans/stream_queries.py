"""Queries that run as streams over the table of events, and parsers over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import safety as Y
from lodestone.plans.registry import query, table
from lodestone.sources import parsers
from lodestone.streaming import state as St
from lodestone.streaming import windows as W


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return W.drained(W.tumbling(W.read(spark, f"{d}/events.parquet"), "1 day", ["event_type"]), "complete", W.scratch(spark))


@query(
    "session_windows",
    "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k",
)
def session_windows(spark, d):
    return W.sessions(table(spark, d, "events"), "6 hours", "user_id")


@query("stream_dedupe", "SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark, d):
    return W.drained(W.deduplicated(W.read(spark, f"{d}/events.parquet"), "event_id", "400 days").select("event_id"), "append", W.scratch(spark))


@query("plain_blocks", r"SELECT doc_id, CAST(unnest(range(0, len(p))) AS INT) AS block_index, sha256(unnest(p)) AS block_hash FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda s: trim(s) <> ''), lambda s: trim(s)) AS p FROM documents)")
def plain_blocks(spark, d):
    return parsers.plain_blocks(table(spark, d, "documents")).select("doc_id", "block_index", F.sha2("content", 256).alias("block_hash"))


@query("line_kinds", r"SELECT kind, count(*) AS lines FROM (SELECT CASE WHEN regexp_matches(l, '^\s*([-*+]|\d+\.)\s+') THEN 'list' WHEN trim(l) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE kind <> 'blank' GROUP BY ALL")
def line_kinds(spark, d):
    return parsers.markdown_lines(table(spark, d, "documents")).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query(
    "stream_sliding",
    f"""SELECT start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id, value, date_trunc('minute', ts) - to_minutes(unnest(range(10))) AS start FROM events)
WHERE start + INTERVAL 10 MINUTE <= {_CLOSED} GROUP BY ALL""",
)
def stream_sliding(spark, d):
    """STR6: ten-minute windows that begin each minute, in event time, over a stream of four pages; those that are closed at its end."""
    e = table(spark, d, "events")
    return W.fed(e, W.seconds("ts"), 4, lambda s: W.sliding(s, "10 minutes", "1 minute", ["user_id"]), W.scratch(spark))[0]


@query(
    "stream_alerts",
    f"""SELECT start, n, errors, round(errors / n, 6) AS error_rate, errors >= 5 AND errors / n > 0.25 AS alert FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def stream_alerts(spark, d):
    """STR9: error rates of closed hours, and whether they raise an alert."""
    e = table(spark, d, "events")

    def rates(s):
        timed = s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
        hours = timed.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
        rate = F.col("errors") / F.col("n")
        return hours.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "errors", F.round(rate, 6).alias("error_rate"), ((F.col("errors") >= 5) & (rate > 0.25)).alias("alert"))

    return W.fed(e, W.seconds("ts"), 3, rates, W.scratch(spark))[0]


@query("stream_static_join", "SELECT event_id, c_mktsegment AS segment FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'error'")
def stream_static_join(spark, d):
    """A stream of events with a table of customers."""
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    joined = lambda s: s.where("event_type <> 'error'").join(customers, F.col("c_custkey") == F.col("user_id")).select("event_id", "segment")
    return W.fed(table(spark, d, "events"), W.seconds("ts"), 3, joined, W.scratch(spark))[0]


@query("stream_stream_join", "SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR")
def stream_stream_join(spark, d):
    """Clicks with the same user's errors of the three hours after them: two streams, joined within their watermarks."""
    near = lambda s: W.followed(s.where("event_type = 'click'"), s.where("event_type = 'error'"), "user_id", "3 hours")
    return W.fed(table(spark, d, "events"), W.seconds("ts"), 3, near, W.scratch(spark))[0]


def stateful(spark):
    """The session with the state store that keyed state needs; streams that have begun keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", St.PROVIDER)
    return spark


def _redacted(x: str, strict: bool) -> str:
    for p, n in [*Y.SECRETS, *(Y.PERSONAL if strict else [])]:
        x = f"regexp_replace({x}, '{p.replace('(?i)', '')}', '[REDACTED:{n.upper()}]', '{'gi' if '(?i)' in p else 'g'}')"
    return x


_LEAK = "CASE WHEN conv_id % 4 = 0 THEN ' key sk-abcdefghijklmnopqrstuv and more words that are not sent' WHEN conv_id % 4 = 1 THEN ' call 13800138000 or write to a.b@c.org now' ELSE '' END"
_SECRET = " OR ".join(f"regexp_matches(t, '{p.replace('(?i)', '')}', 'i')" for p, _ in Y.SECRETS)


@query(
    "stream_dlp_live",
    f"""WITH c AS (SELECT conv_id AS stream_id, conv_id % 3 <> 1 AS strict, string_agg(text, ' ' ORDER BY turn) || {_LEAK} AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT stream_id, strict AND ({_SECRET}) AS blocked, CASE WHEN strict AND ({_SECRET}) THEN NULL WHEN strict THEN {_redacted('t', True)} ELSE {_redacted('t', False)} END AS content FROM c""",
)
def stream_dlp_live(spark, d):
    """STR1: answers that come in chunks of 24 characters, in three pages, are sent on as far as nothing in them can be part of a secret."""
    k = F.col("conv_id")
    whole = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    tail = F.when(k % 4 == 0, " key sk-abcdefghijklmnopqrstuv and more words that are not sent").when(k % 4 == 1, " call 13800138000 or write to a.b@c.org now").otherwise("")
    t = whole.select(k.alias("stream_id"), (k % 3 != 1).alias("strict"), F.concat("t", tail).alias("t")).where("t <> ''")
    n = F.ceil(F.length("t") / 24).cast("int")
    chunks = t.select("stream_id", "strict", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("t", i * 24 + 1, F.lit(24)))).alias("seq", "text"))
    chunks = chunks.select("stream_id", "seq", "text", (F.col("seq") == F.col("n") - 1).alias("last"), "strict")
    parts, _ = W.fed(chunks, F.col("seq").cast("double"), 3, St.checked_answers, W.scratch(stateful(spark)))
    sent = parts.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "").alias("content"), F.bool_or(F.col("action") == "block").alias("blocked"))
    return sent.select("stream_id", "blocked", F.when(~F.col("blocked"), F.col("content")).alias("content"))


@query(
    "stream_memory",
    """WITH e AS (SELECT user_id AS session_id, event_id AS entry_id, ts, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
SELECT session_id, entry_id FROM (SELECT * FROM e WHERE ts > last - INTERVAL 48 HOURS AND last + INTERVAL 48 HOURS >= (SELECT max(ts) FROM events)) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, entry_id DESC) <= 4""",
)
def stream_memory(spark, d):
    """STR10: what each session remembers once the stream, which comes in four pages, has ended: sessions that were silent for 48 hours nothing."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("entry_id"), "ts")
    return St.newest(W.fed(e, W.seconds("ts"), 4, St.session_memory, W.scratch(stateful(spark)))[0])
