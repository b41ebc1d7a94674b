"""Queries of filters, access control, joins, change data, windows and text safety."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import changes as D
from lodestone.operators import chunking as C
from lodestone.operators import scope as A
from lodestone.plans import registry as S
from lodestone.plans.registry import query, table

_SCOPE = "SELECT *, doc_id % 3 AS organization_id, doc_id % 7 AS workspace_id, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 4 * 10 END AS classification_level, 'G00' || (1 + doc_id % 2) AS generation_id FROM documents"


@query("scope_filter", f"SELECT doc_id, lang, source FROM ({_SCOPE}) WHERE organization_id = 1 AND classification_level <= 20 AND generation_id = 'G001'")
def scope_filter(spark, d):
    return A.scoped(A.with_scope(table(spark, d, "documents")), organization=1, clearance=20, generation="G001").select("doc_id", "lang", "source")


@query(
    "secure_drop_reasons",
    f"""SELECT coalesce(CASE WHEN organization_id <> 1 THEN 'tenant_acl' WHEN workspace_id <> 2 THEN 'workspace_acl' WHEN classification_level IS NULL THEN 'classification_unknown' WHEN classification_level > 20 THEN 'classification'
WHEN generation_id <> 'G001' THEN 'generation_mismatch' END, 'returned') AS reason, count(*) AS rows FROM ({_SCOPE}) GROUP BY ALL""",
)
def secure_drop_reasons(spark, d):
    reason = F.coalesce(A.drop_reason(1, 2, 20, "G001"), F.lit("returned"))
    return A.with_scope(table(spark, d, "documents")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("template_content_search", "SELECT doc_id, source, lang FROM documents WHERE text LIKE '%License%'")
def template_content_search(spark, d):
    return spark.sql("SELECT doc_id, source, lang FROM {docs} WHERE text LIKE concat('%', :term, '%')", docs=table(spark, d, "documents"), args={"term": "License"})


@query("status_by_domain", "SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY ALL")
def status_by_domain(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query("keyset_page", "SELECT o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey < 9000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def keyset_page(spark, d):
    page = table(spark, d, "orders").where("o_orderkey < 9000").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    return page.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderdate", "c_name")


@query("hash_sample", "SELECT event_id, event_type FROM events WHERE CAST('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10")
def hash_sample(spark, d):
    return table(spark, d, "events").where(T.hash_bucket(F.col("event_id")) < 10).select("event_id", "event_type")


_RATE = "CASE event_type WHEN 'error' THEN 100 WHEN 'purchase' THEN 50 ELSE 5 END"


@query(
    "stratified_budget_sample",
    f"SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < {_RATE} QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 20",
)
def stratified_budget_sample(spark, d):
    rate = F.when(F.col("event_type") == "error", 100).when(F.col("event_type") == "purchase", 50).otherwise(5)
    chosen = table(spark, d, "events").where(T.hash_bucket(F.col("event_id")) < rate).withColumn("day", F.to_date("ts"))
    return chosen.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))).where("n <= 20").select("event_id", "day")


@query("eligible_observations", "SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND event_type IN ('click', 'view', 'purchase') AND value IS NOT NULL AND props IS NOT NULL AND props <> ''")
def eligible_observations(spark, d):
    return table(spark, d, "events").where((F.col("event_type") != "error") & F.col("event_type").isin("click", "view", "purchase") & F.col("value").isNotNull() & (F.col("props") != "")).select("event_id", "user_id")


@query("degradation_path", "SELECT path, count(*) AS calls FROM (SELECT CASE WHEN ms > 500 THEN 'rerank' WHEN ms >= 200 THEN 'no_rerank' WHEN ms >= 50 THEN 'fast' ELSE 'none' END AS path FROM (SELECT event_id % 800 AS ms FROM events)) GROUP BY ALL")
def degradation_path(spark, d):
    ms = F.col("event_id") % 800
    path = F.when(ms > 500, "rerank").when(ms >= 200, "no_rerank").when(ms >= 50, "fast").otherwise("none")
    return table(spark, d, "events").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("calls"))


@query(
    "alert_rules",
    "WITH m AS (SELECT event_type AS metric, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL), r(metric, op, bound) AS (VALUES ('error', '>', 10.0), ('click', '<', 1000.0), ('view', '==', 0.0), ('absent', '>', 0.0)) SELECT r.metric, op, CASE WHEN v IS NULL THEN 'NODATA' WHEN (op = '>' AND v > bound) OR (op = '<' AND v < bound) OR (op = '==' AND v = bound) THEN 'FIRING' ELSE 'OK' END AS state FROM r LEFT JOIN m USING (metric)",
)
def alert_rules(spark, d):
    rules = spark.createDataFrame([("error", ">", 10.0), ("click", "<", 1000.0), ("view", "==", 0.0), ("absent", ">", 0.0)], "metric string, op string, bound double")
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    v, b, op = F.col("v"), F.col("bound"), F.col("op")
    fires = ((op == ">") & (v > b)) | ((op == "<") & (v < b)) | ((op == "==") & (v == b))
    return rules.join(m, "metric", "left").select("metric", "op", F.when(v.isNull(), "NODATA").when(fires, "FIRING").otherwise("OK").alias("state"))


@query("forbidden_exclusion", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE text LIKE '%token = %')")
def forbidden_exclusion(spark, d):
    bad = table(spark, d, "documents").where(F.col("text").contains("token = ")).select("doc_id")
    return table(spark, d, "labels").join(bad, "doc_id", "left_anti")


@query("orphans_and_missing", "SELECT count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS matched, count_if(b.doc_id IS NULL) AS missing, count_if(a.doc_id IS NULL) AS orphans FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT vec_id AS doc_id FROM embeddings) b ON a.doc_id = b.doc_id")
def orphans_and_missing(spark, d):
    return D.reconcile(table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("acl_drift", f"SELECT reason, count(*) AS hits FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.workspace_id <> vec_id % 5 THEN 'workspace' WHEN d.organization_id <> 1 THEN 'organization' WHEN coalesce(d.classification_level, 99) > 20 THEN 'classification' ELSE 'kept' END AS reason FROM embeddings LEFT JOIN ({_SCOPE}) d ON d.doc_id = vec_id) GROUP BY ALL")
def acl_drift(spark, d):
    known = A.with_scope(table(spark, d, "documents")).select("doc_id", "workspace_id", "organization_id", "classification_level")
    j = table(spark, d, "embeddings").select("vec_id").join(known, F.col("doc_id") == F.col("vec_id"), "left")
    reason = F.when(F.col("doc_id").isNull(), "missing").when(F.col("workspace_id") != F.col("vec_id") % 5, "workspace").when(F.col("organization_id") != 1, "organization").when(F.coalesce("classification_level", F.lit(99)) > 20, "classification").otherwise("kept")
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("hits"))


@query("order_dimension_lookup", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def order_dimension_lookup(spark, d):
    place = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # nations and regions are of fixed number
    own = table(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, d, "orders").join(own, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


_WIN = f"SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(t, 1 + i * 448, 512) AS content FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 447) // 448)) AS i FROM (SELECT doc_id, {S.collapsed('text')} AS t FROM documents))"


@query("fixed_window_chunks", f"SELECT doc_id, chunk_index, sha256(content) AS chunk_hash FROM ({_WIN})")
def fixed_window_chunks(spark, d):
    return C.fixed_windows(table(spark, d, "documents")).select("doc_id", "chunk_index", T.content_hash(F.col("content")).alias("chunk_hash"))


@query(
    "chunk_diff",
    f"""WITH o AS (SELECT doc_id || ':' || chunk_index AS k, sha256(content) AS h FROM ({_WIN}) WHERE doc_id % 5 <> 0), n AS (SELECT doc_id || ':' || (chunk_index + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS k, sha256(CASE WHEN (doc_id + chunk_index) % 6 = 0 THEN upper(content) ELSE content END) AS h FROM ({_WIN}) WHERE doc_id % 4 <> 0),
x AS (SELECT CASE WHEN o.h = n.h THEN 'unchanged' WHEN n.h IN (SELECT h FROM o) THEN 'moved' WHEN o.h IS NOT NULL THEN 'modified' ELSE 'added' END AS kind FROM n LEFT JOIN o USING (k) UNION ALL SELECT 'deleted' FROM o WHERE h NOT IN (SELECT h FROM n)) SELECT kind, count(*) AS chunks FROM x GROUP BY ALL""",
)
def chunk_diff(spark, d):
    chunks = C.fixed_windows(table(spark, d, "documents"))

    def keyed(index, content):
        return (F.concat_ws(":", F.col("doc_id").cast("string"), index.cast("string")).alias("logical_key"), T.content_hash(content).alias("chunk_hash"))

    old = chunks.where("doc_id % 5 <> 0").select(*keyed(F.col("chunk_index"), F.col("content")))
    moved = F.col("chunk_index") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    edited = F.when((F.col("doc_id") + F.col("chunk_index")) % 6 == 0, F.upper("content")).otherwise(F.col("content"))
    new = chunks.where("doc_id % 4 <> 0").select(*keyed(moved, edited))
    return D.diff_chunks(old, new).groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"))


@query("latest_version", "SELECT source, max_by(doc_id, n_chars * 1000000 + doc_id) AS current_doc, CAST(max(n_chars) AS BIGINT) AS version, count(*) AS versions FROM documents GROUP BY ALL")
def latest_version(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("current_doc"), F.max("n_chars").alias("version"), F.count(F.lit(1)).alias("versions"))


@query("memory_window", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def memory_window(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 4").select("conv_id", "turn", "role")


@query("abuse_sliding_window", "SELECT event_id, user_id, recent, CASE WHEN recent >= 10 THEN 'block' WHEN recent >= 5 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))")
def abuse_sliding_window(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-600, 0)
    recent = table(spark, d, "events").withColumn("recent", F.count(F.lit(1)).over(w))
    return recent.select("event_id", "user_id", "recent", F.when(F.col("recent") >= 10, "block").when(F.col("recent") >= 5, "warn").otherwise("ok").alias("level"))


@query("rate_windows", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS calls, count(*) <= 2 AS allowed FROM events GROUP BY ALL")
def rate_windows(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) <= 2).alias("allowed"))


@query("circuit_breaker", "SELECT event_id, failures >= 4 AS open FROM (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS failures FROM events)")
def circuit_breaker(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", (F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w) >= 4).alias("open"))


_HOST = r"^https?://([^/:?#]+)"


@query("url_host_check", f"SELECT page_id, lower(regexp_extract(url, '{_HOST}', 1)) AS host, regexp_matches(lower(regexp_extract(url, '{_HOST}', 1)), '\\.example\\.(com|org)$') AS allowed FROM pages")
def url_host_check(spark, d):
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    return table(spark, d, "pages").select("page_id", host.alias("host"), host.rlike(r"\.example\.(com|org)$").alias("allowed"))


@query(
    "parse_quality",
    "SELECT doc_id, CAST(floor(length(text) / 4 + 0.999) AS BIGINT) AS tokens, CASE WHEN length(trim(text)) = 0 THEN 'QUARANTINE' WHEN length(text) < 200 OR contains(text, chr(65533)) THEN 'DEGRADED' ELSE 'PASS' END AS verdict FROM documents",
)
def parse_quality(spark, d):
    t = F.col("text")
    verdict = F.when(F.length(F.trim(t)) == 0, "QUARANTINE").when((F.length(t) < 200) | t.contains("�"), "DEGRADED").otherwise("PASS")
    return table(spark, d, "documents").select("doc_id", T.approx_tokens(t).alias("tokens"), verdict.alias("verdict"))


@query("content_hashes", f"SELECT doc_id, sha256(text) AS content_hash, sha256({S.collapsed('text')}) AS normalised_hash, md5(text) AS checksum FROM documents")
def content_hashes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.content_hash(t).alias("content_hash"), T.normalised_hash(t).alias("normalised_hash"), F.md5(t).alias("checksum"))


@query("exact_duplicates", "SELECT md5(text) AS checksum, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("checksum")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
