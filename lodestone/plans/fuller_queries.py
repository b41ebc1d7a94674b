"""Queries that state operators in full where a simpler query of the same family is registered as well."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import fields as L
from lodestone.functions import safety as Y
from lodestone.functions import statistics as X
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import chunking as C
from lodestone.operators import retrieval as R
from lodestone.operators.lexical import bm25_fields
from lodestone.plans import ranking_queries as K
from lodestone.plans import registry as S
from lodestone.plans import safety_queries as S_
from lodestone.plans.registry import query, table
from lodestone.sources import parsers


def n_():
    return F.count(F.lit(1))


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_FEW = "SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'zzzz' ELSE text END AS query FROM benchmark"


@query("bm25_zero_kept", f"WITH {S.bm25(queries=_FEW, name='zk', boost=False, least=1.0)} SELECT q.query_id, d.doc_id, coalesce(zk.score, 0.0) AS score, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(zk.score, 0.0) DESC, d.doc_id) AS INT) AS rank FROM ({_FEW}) q CROSS JOIN documents d LEFT JOIN zk ON zk.query_id = q.query_id AND zk.doc_id = d.doc_id QUALIFY rank <= 10")
def bm25_zero_kept(spark, d):
    """RET3: documents without a score fill a list by id. They are among the 2 k least ids, so no query meets all documents."""
    k, docs = 10, table(spark, d, "documents").select("doc_id", "text")
    q = items(spark, d).withColumn("query", F.when(F.col("query_id") % 4 == 0, "zzzz").otherwise(F.col("query")))
    run = R.top_k(R.bm25(docs, q, boost=False, least_avgdl=1.0), k).drop("rank")
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    rest = q.select("query_id").join(F.broadcast(first)).join(run, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return R.top_k(run.unionByName(rest), k)


_FIELD = {"title": "title", "section": "coalesce(sections[1], '')", "body": "body"}


def _field_bm25(name: str) -> str:
    return S.bm25(docs=f"SELECT chunk_key AS doc_id, {_FIELD[name]} AS text FROM {K._PARSED}", queries=f"SELECT query_id, query FROM {K.ASKED.sql}", name=f"f_{name}", tok=_full_tokens)


def _full_tokens(x: str) -> str:
    cjk = f"regexp_replace(lower({x}), '[^{S.CJK}]', '', 'g')"
    return f"list_concat({S.tokens(x)}, list_transform(range(1, length({cjk})), lambda i: substr({cjk}, i, 2)))"


@query(
    "multi_match_phrases",
    f"""WITH {_field_bm25('title')}, {_field_bm25('section')}, {_field_bm25('body')}, k AS (SELECT query_id, doc_id FROM f_title UNION SELECT query_id, doc_id FROM f_section UNION SELECT query_id, doc_id FROM f_body)
SELECT k.query_id, k.doc_id AS chunk_key, round(greatest(5 * coalesce(t.score, 0), 4 * coalesce(s.score, 0), coalesce(b.score, 0)) + CASE WHEN trim(a.query) <> '' AND contains(p.title, a.query) THEN 5 ELSE 0 END + CASE WHEN trim(a.query) <> '' AND contains(coalesce(p.sections[1], ''), a.query) THEN 4 ELSE 0 END, 6) AS score
FROM k JOIN {K.ASKED.sql} a USING (query_id) JOIN {K._PARSED} p ON p.chunk_key = k.doc_id LEFT JOIN f_title t ON t.query_id = k.query_id AND t.doc_id = k.doc_id LEFT JOIN f_section s ON s.query_id = k.query_id AND s.doc_id = k.doc_id LEFT JOIN f_body b ON b.query_id = k.query_id AND b.doc_id = k.doc_id""",
)
def multi_match_phrases(spark, d):
    """RET5: the best of the weighted fields, and boosts where title or section holds the query as a phrase."""
    c = K.CORPUS.df(spark, d).select("chunk_key", L.parse(F.col("content")).alias("f")).select("chunk_key", F.col("f.title").alias("title"), F.coalesce(F.get("f.sections", F.lit(0)), F.lit("")).alias("section"), F.col("f.body").alias("body"))
    q = K.ASKED.df(spark, d)
    for field in ("title", "section"):
        holding = R.containing(c.select(F.col("chunk_key").alias("doc_id"), F.col(field).alias("text")), q.where("trim(query) <> ''"))
        c = c.join(holding.groupBy(F.col("doc_id").alias("chunk_key")).agg(F.collect_list("query_id").alias(f"{field}_holds")), "chunk_key", "left")
    return bm25_fields(c, q, "chunk_key", {"title": 5, "section": 4, "body": 1}, {"title_holds": 5, "section_holds": 4})


@query("rrf_by_source", f"WITH {S.bm25()}, t AS ({S.top('bm25', 10)}), r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id, doc_id % 2 ORDER BY rank) AS r FROM t), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 6) AS fused, max(score) AS own FROM r GROUP BY ALL) SELECT query_id, doc_id, fused AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, own DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 20")
def rrf_by_source(spark, d):
    """RET17: two sources' lists (even and odd keys) fused; equal sums go by the chunk's own score."""
    t = R.top_k(R.bm25(table(spark, d, "documents"), items(spark, d)), 10)
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("query_id", F.col("doc_id") % 2).orderBy("rank")))
    f = r.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 6).alias("score"), F.max("score").alias("own"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("own"), "doc_id"))).where("rank <= 20").select("query_id", "doc_id", "score", "rank")


@query(
    "best_hit_expansion",
    rf"""WITH {S.bm25()}, t AS ({S.top('bm25', 1)}), w AS (SELECT doc_id, i, substr(x, CAST(i * 448 + 1 AS BIGINT), 512) AS c FROM (SELECT doc_id, {S.collapsed("coalesce(text, '')")} AS x, unnest(range(0, CAST(ceil(length({S.collapsed("coalesce(text, '')")}) / 448) AS BIGINT))) AS i FROM documents)),
h AS (SELECT query_id, t.doc_id, i FROM t JOIN w USING (doc_id) JOIN benchmark b ON b.item_id = t.query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(list_distinct({S.tokens('b.text')}), {S.tokens('c')})) DESC, i) = 1)
SELECT query_id, h.doc_id, h.i AS hit, count(*) AS n_chunks, md5(string_agg(c, chr(10) || chr(10) ORDER BY w.i)) AS content_md5 FROM h JOIN w ON w.doc_id = h.doc_id AND w.i BETWEEN h.i - 1 AND h.i + 1 GROUP BY ALL""",
)
def best_hit_expansion(spark, d):
    """RET31 and JN12: the window of the best document that holds most of the query's words, with the ones before and after it."""
    docs, asked = table(spark, d, "documents"), items(spark, d)
    hit = R.small(R.top_k(R.bm25(docs, asked), 1).select("query_id", "doc_id"))
    w = C.fixed_windows(docs.select("doc_id", "text").join(hit.select("doc_id").distinct(), "doc_id", "left_semi"))
    held = F.size(F.array_intersect(T.tokens(F.col("query")), T.tokens(F.col("content"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("held"), "chunk_index"))
    best = w.join(hit, "doc_id").join(R.small(asked), "query_id").withColumn("held", held).withColumn("p", place).where("p = 1").select("query_id", "doc_id", F.col("chunk_index").alias("hit"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    near = w.join(best, "doc_id").where(F.abs(F.col("chunk_index") - F.col("hit")) <= 1)
    return near.groupBy("query_id", "doc_id", F.col("hit").cast("long").alias("hit")).agg(n_().alias("n_chunks"), F.md5(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n")).alias("content_md5"))


#: Sentences of the documents as evidence that two attempts found for every twentieth of them: those of the four documents after it, some found twice.
_EVIDENCE = S.Derived(
    "SELECT d.doc_id - d.doc_id % 20 AS query_id, a.n_regionkey AS attempt, 'e' || (d.doc_id % 20 - d.doc_id % 2) AS evidence_id, d.source AS source, CASE d.doc_id % 6 WHEN 1 THEN '该接口支持批量导入 ' WHEN 2 THEN '旧版不支持批量 ' WHEN 3 THEN '导入可用 ' ELSE '' END || split_part(d.text, '.', 1) AS content, "
    "CAST((d.doc_id * 37 + a.n_regionkey * 11) % 100 AS DOUBLE) / 100 AS score FROM documents d JOIN nation a ON a.n_nationkey % 5 = d.doc_id % 5 WHERE d.text IS NOT NULL AND d.doc_id % 20 < 6 AND a.n_regionkey < 2 + d.doc_id % 3"
)
_CONTRA = [("是", "不是"), ("支持", "不支持"), ("可用", "不可用"), ("支持", "拒绝")]


@query(
    "evidence_conflicts",
    f"""WITH b AS (SELECT query_id, evidence_id, arg_max(source, score) AS source, arg_max(content, score) AS content, max(score) AS s, count(*) AS seen FROM {_EVIDENCE.sql} GROUP BY ALL), n AS (SELECT *, round(CASE WHEN max(s) OVER w - min(s) OVER w <= 1e-9 THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 4) AS score FROM b WINDOW w AS (PARTITION BY query_id)),
c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, evidence_id) <= 2), x AS (SELECT query_id, string_agg(lower(content), ' || ' ORDER BY score DESC, evidence_id) AS t, count(*) AS chunks, string_agg(evidence_id || '=' || score, ',' ORDER BY score DESC, evidence_id) AS ids FROM c GROUP BY ALL)
SELECT x.query_id, ids, d.deduped, d.sources, d.diversity, CASE WHEN chunks < 2 THEN '' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN contains(t, '{a}') AND contains(t, '{b}') THEN 'contradiction:{a}/{b}' END" for a, b in _CONTRA)}], lambda e: e IS NOT NULL)[1:3], ',') END AS conflicts
FROM x JOIN (SELECT query_id, CAST(sum(seen - 1) AS BIGINT) AS deduped, count(DISTINCT source) AS sources, round(count(DISTINCT source) / count(*), 3) AS diversity FROM n GROUP BY ALL) d USING (query_id)""",
)
def evidence_conflicts(spark, d):
    """RET37: evidence of all attempts, each id by its best score, scaled, at most two a source, with signs of contradiction."""
    at = F.col("score")
    b = _EVIDENCE.df(spark, d).groupBy("query_id", "evidence_id").agg(F.max_by("source", at).alias("source"), F.max_by("content", at).alias("content"), F.max(at).alias("s"), n_().alias("seen"))
    w = Window.partitionBy("query_id")
    lo, hi = F.min("s").over(w), F.max("s").over(w)
    n = b.withColumn("score", F.round(F.when(hi - lo <= 1e-9, 1.0).otherwise((F.col("s") - lo) / (hi - lo)), 4))
    order = [F.desc("score"), F.asc("evidence_id")]
    c = n.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order))).where("k <= 2").withColumn("p", F.row_number().over(w.orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("p", F.concat("evidence_id", F.lit("="), F.col("score").cast("string")).alias("id"), F.lower("content").alias("t"))))
    x = c.groupBy("query_id").agg(rows.alias("r"))
    text = F.array_join(F.transform("r", lambda e: e["t"]), " || ")
    found = F.slice(F.filter(F.array(*(F.when(text.contains(a) & text.contains(z), F.lit(f"contradiction:{a}/{z}")) for a, z in _CONTRA)), lambda e: e.isNotNull()), 1, 3)
    stats = n.groupBy("query_id").agg(F.sum(F.col("seen") - 1).alias("deduped"), F.count_distinct("source").alias("sources"), F.round(F.count_distinct("source") / n_(), 3).alias("diversity"))
    return x.join(stats, "query_id").select("query_id", F.array_join(F.transform("r", lambda e: e["id"]), ",").alias("ids"), "deduped", "sources", "diversity", F.when(F.size("r") < 2, "").otherwise(F.array_join(found, ",")).alias("conflicts"))


_PLANS = S.Derived(
    "SELECT doc_id AS query_id, CASE WHEN doc_id % 40 = 0 THEN ARRAY(split_part(text, ' ', 1) || ' 批量', split_part(text, ' ', 2), 'never asked') ELSE ARRAY(split_part(text, ' ', 3)) END AS queries, CAST(1 + doc_id % 3 AS INT) AS attempt, 3 AS most, doc_id % 80 <> 60 AS budget FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0"
)


@query(
    "evidence_sufficiency",
    rf"""WITH e AS (SELECT query_id, count(DISTINCT source) AS sources, string_agg(lower(content), ' || ' ORDER BY evidence_id) AS t, list_distinct(flatten(list(list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) BETWEEN 2 AND 12)))) AS words, count(DISTINCT evidence_id) AS chunks FROM {_EVIDENCE.sql} GROUP BY ALL),
p AS (SELECT p.*, coalesce(sources, 0) AS sources, least(1.0, coalesce(sources, 0) / len(queries)) AS coverage, list_filter(queries, lambda q: words IS NULL OR len(list_filter(list_filter(regexp_split_to_array(lower(q), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1), lambda w: list_contains(words, w))) = 0) AS missing,
coalesce(chunks >= 2 AND ((contains(t, '是') AND contains(t, '不是')) OR (contains(t, '支持') AND contains(t, '不支持')) OR (contains(t, '可用') AND contains(t, '不可用'))), false) AS conflict FROM {_PLANS.sql} p LEFT JOIN e USING (query_id))
SELECT query_id, round(coverage, 2) AS coverage, array_to_string(missing, ',') AS missing, CASE WHEN coverage >= 0.6 AND NOT conflict THEN 'sufficient' WHEN conflict THEN 'conflicting_evidence' WHEN NOT budget THEN 'budget_exhausted' WHEN attempt >= most THEN 'attempt_limit' ELSE '' END AS stop_reason, round(least(0.95, 0.3 + coverage), 2) AS confidence FROM p""",
)
def evidence_sufficiency(spark, d):
    """RET38: sources for queries, queries without a keyword in any content, contradictions, and why to stop."""
    split = lambda x: F.split(F.lower(x), r"[^\p{L}\p{N}_]+")
    e = _EVIDENCE.df(spark, d)
    words = F.flatten(F.collect_list(F.filter(split(F.col("content")), lambda w: F.length(w).between(2, 12))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", F.lower("content").alias("t")))), lambda x: x["t"]), " || ")
    e = e.groupBy("query_id").agg(F.count_distinct("source").alias("sources"), text.alias("t"), words.alias("words"), F.count_distinct("evidence_id").alias("chunks"))
    clash = F.lit(False)
    for a, z in _CONTRA[:3]:
        clash = clash | F.col("t").contains(a) & F.col("t").contains(z)
    p = _PLANS.df(spark, d).join(e, "query_id", "left").withColumns({"coverage": F.least(F.lit(1.0), F.coalesce("sources", F.lit(0)) / F.size("queries")), "conflict": F.coalesce((F.col("chunks") >= 2) & clash, F.lit(False))})
    missing = F.filter("queries", lambda q: F.col("words").isNull() | ~F.arrays_overlap(F.filter(split(q), lambda w: F.length(w) > 1), F.col("words")))
    stop = F.when((F.col("coverage") >= 0.6) & ~F.col("conflict"), "sufficient").when(F.col("conflict"), "conflicting_evidence").when(~F.col("budget"), "budget_exhausted").when(F.col("attempt") >= F.col("most"), "attempt_limit").otherwise("")
    return p.select("query_id", F.round("coverage", 2).alias("coverage"), F.array_join(missing, ",").alias("missing"), stop.alias("stop_reason"), F.round(F.least(F.lit(0.95), 0.3 + F.col("coverage")), 2).alias("confidence"))


@query("source_orchestration", f"WITH {S.bm25()}, t AS ({S.top('bm25', 10)}), x AS (SELECT query_id, CASE doc_id % 3 WHEN 0 THEN 'InternalKB' WHEN 1 THEN 'ProductDocs' ELSE 'PolicyKB' END AS source_kind, doc_id, rank FROM t) SELECT source_kind, count(*) AS candidates, count_if(rank <= 5) AS returned, count(DISTINCT query_id) AS queries, round(count(DISTINCT query_id) / (SELECT count(DISTINCT query_id) FROM t), 6) AS coverage FROM x GROUP BY ALL")
def source_orchestration(spark, d):
    """RET34: what each kind of source gave and returned, and the share of queries that it covers."""
    t = R.top_k(R.bm25(table(spark, d, "documents"), items(spark, d)), 10)
    k = F.col("doc_id") % 3
    x = t.withColumn("source_kind", F.when(k == 0, "InternalKB").when(k == 1, "ProductDocs").otherwise("PolicyKB"))
    g = x.groupBy("source_kind").agg(n_().alias("candidates"), F.count_if(F.col("rank") <= 5).alias("returned"), F.count_distinct("query_id").alias("queries"))
    return g.crossJoin(F.broadcast(t.agg(F.count_distinct("query_id").alias("all")))).select("source_kind", "candidates", "returned", "queries", F.round(F.col("queries") / F.col("all"), 6).alias("coverage"))  # one row


#: Users' turns in the form that prompts have: passages that were found, earlier turns, the present question.
_PROMPT = S.Derived(
    "SELECT u.conv_id * 1000 + u.turn AS id, CASE WHEN u.turn % 4 = 0 THEN '系统' || chr(10) ELSE '' END || CASE WHEN u.conv_id % 3 = 0 THEN '检索知识：' || chr(10) || '无' WHEN u.conv_id % 3 = 1 THEN '检索知识：' || chr(10) || coalesce(a.text, '') ELSE '' END || chr(10) || chr(10) || "
    "CASE WHEN u.conv_id % 2 = 0 THEN '可用 skill 指引' || chr(10) ELSE '' END || 'user: ' || u.text || CASE WHEN u.turn % 3 = 0 THEN chr(10) || '当前输入：' || u.text || chr(10) || 'x' ELSE '' END AS prompt FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 WHERE u.role = 'user' AND u.text IS NOT NULL"
)


@query(
    "prompt_extraction",
    rf"""SELECT id, substr(trim(split_part(trim(CASE WHEN contains(prompt, '当前输入：') THEN string_split(prompt, '当前输入：')[-1] WHEN contains(prompt, 'user: ') THEN string_split(prompt, 'user: ')[-1] ELSE '' END), chr(10), 1)), 1, 500) AS question,
array_to_string(list_filter(list_transform(string_split(prompt, '检索知识：' || chr(10))[2:], lambda c: trim(regexp_replace(c, '(?s)\n\n(可用 skill 指引|高风险处理规则|user:).*$', ''))), lambda c: c <> '' AND c <> '无'), '|') AS contexts FROM {_PROMPT.sql}""",
)
def prompt_extraction(spark, d):
    """RET47: the last question of a prompt and the passages that it quotes."""
    p = F.col("prompt")
    last = lambda mark: F.element_at(F.split(p, mark), -1)
    q = F.when(p.contains("当前输入："), last("当前输入：")).when(p.contains("user: "), last("user: ")).otherwise("")
    parts = F.split(p, "检索知识：\n")
    ctx = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: F.trim(F.regexp_replace(c, r"(?s)\n\n(可用 skill 指引|高风险处理规则|user:).*$", ""))), lambda c: (c != "") & (c != "无"))
    return _PROMPT.df(spark, d).select("id", F.substring(F.trim(F.split_part(F.trim(q), F.lit("\n"), F.lit(1))), 1, 500).alias("question"), F.array_join(ctx, "|").alias("contexts"))


@query("cache_entries", "SELECT sha256('o' || doc_id % 3 || '|w' || doc_id % 7 || '|v1|' || coalesce(source, '') || '|k10|flags=hybrid,rerank|G001') AS cache_key, count(*) AS entries, count_if(text IS NULL OR length(text) < 200) AS negative, min(CASE WHEN text IS NULL OR length(text) < 200 THEN 30 ELSE 300 END) AS ttl_seconds, 'org:' || any_value(doc_id % 3) || ',gen:G001' AS tags FROM documents GROUP BY doc_id % 3, doc_id % 7, source")
def cache_entries(spark, d):
    """RET43: keys over all that a result depends on, tags for invalidation, a short life for empty results."""
    k = F.col("doc_id")
    empty = F.col("text").isNull() | (F.length("text") < 200)
    g = table(spark, d, "documents").groupBy((k % 3).alias("o"), (k % 7).alias("w"), "source").agg(n_().alias("entries"), F.count_if(empty).alias("negative"), F.min(F.when(empty, 30).otherwise(300)).alias("ttl_seconds"))
    key = F.sha2(F.concat(F.lit("o"), F.col("o"), F.lit("|w"), F.col("w"), F.lit("|v1|"), F.coalesce("source", F.lit("")), F.lit("|k10|flags=hybrid,rerank|G001")), 256)
    return g.select(key.alias("cache_key"), "entries", "negative", "ttl_seconds", F.concat(F.lit("org:"), F.col("o"), F.lit(",gen:G001")).alias("tags"))


@query("embedding_cache_table", "WITH k AS (SELECT source, sha256('local|m1|64|' || text) AS key, doc_id FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0) SELECT source, count(*) AS requests, count(c.key) AS hits, count(DISTINCT CASE WHEN c.key IS NULL THEN k.key END) AS to_embed, round(count(c.key) / count(*), 6) AS hit_rate FROM k LEFT JOIN c USING (key) GROUP BY ALL")
def embedding_cache_table(spark, d):
    """RET44: texts by provider, model, dimension and content; what the table has is reused, the rest is embedded once."""
    k = table(spark, d, "documents").where("text is not null").select("source", F.sha2(F.concat(F.lit("local|m1|64|"), "text"), 256).alias("key"), "doc_id")
    c = k.where("doc_id % 2 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    j = k.join(c, "key", "left")
    hits = F.count("hit")
    return j.groupBy("source").agg(n_().alias("requests"), hits.alias("hits"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("key"))).alias("to_embed"), F.round(hits / n_(), 6).alias("hit_rate"))


_CONFIGS = "(SELECT source AS label, round(avg(quality), 6) AS q, CAST(sum(length(text)) AS DOUBLE) AS cost, CAST(max(length(text)) AS DOUBLE) AS latency FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"


@query("pareto_tolerant", f"SELECT b.label, b.q, NOT EXISTS (SELECT 1 FROM {_CONFIGS} a WHERE a.label <> b.label AND a.q >= b.q AND a.cost <= b.cost AND a.latency <= b.latency * 1.15 AND (a.q > b.q OR a.cost < b.cost OR a.latency < b.latency)) AS optimal FROM {_CONFIGS} b")
def pareto_tolerant(spark, d):
    """AGG27: quality against cost and latency, with 15 % of tolerance on latency. Configurations are broadcast to each other up to 100,000 of them."""
    m = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")).join(table(spark, d, "labels"), "doc_id")
    m = m.groupBy(F.col("source").alias("label")).agg(F.round(F.avg("quality"), 6).alias("q"), F.sum("n").cast("double").alias("cost"), F.max("n").cast("double").alias("latency"))
    a = m.select(*(F.col(c).alias(f"_{c}") for c in m.columns))
    beats = (F.col("_label") != F.col("label")) & (F.col("_q") >= F.col("q")) & (F.col("_cost") <= F.col("cost")) & (F.col("_latency") <= F.col("latency") * 1.15) & ((F.col("_q") > F.col("q")) | (F.col("_cost") < F.col("cost")) | (F.col("_latency") < F.col("latency")))
    lost = m.join(R.small(a), beats, "left_semi").select("label", F.lit(True).alias("lost"))
    return m.join(lost, "label", "left").select("label", "q", F.col("lost").isNull().alias("optimal"))


@query("repeatability_verdict", "WITH m AS (SELECT o_orderstatus AS metric, o_orderkey % 5 AS run, avg(o_totalprice) / 100000 AS v FROM orders GROUP BY ALL) SELECT metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, coalesce(stddev_samp(v), 0) <= 0.1 AS repeatable FROM m GROUP BY ALL")
def repeatability_verdict(spark, d):
    """AGG30."""
    m = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("metric"), (F.col("o_orderkey") % 5).alias("run")).agg((F.avg("o_totalprice") / 100000).alias("v"))
    std = F.coalesce(F.stddev_samp("v"), F.lit(0.0))
    return m.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), (std <= 0.1).alias("repeatable"))


@query("feedback_reasons", "SELECT trim(reason) AS reason, count(*) AS n, count_if(event_type = 'error') AS open FROM (SELECT event_type, unnest(string_split(CASE event_id % 3 WHEN 0 THEN 'slow, wrong' WHEN 1 THEN 'wrong' ELSE '' END, ',')) AS reason FROM events) WHERE trim(reason) <> '' GROUP BY ALL")
def feedback_reasons(spark, d):
    """AGG32: reasons listed in one field, each counted."""
    k = F.col("event_id") % 3
    r = table(spark, d, "events").select("event_type", F.explode(F.split(F.when(k == 0, "slow, wrong").when(k == 1, "wrong").otherwise(""), ",")).alias("r"))
    return r.where("trim(r) <> ''").groupBy(F.trim("r").alias("reason")).agg(n_().alias("n"), F.count_if(F.col("event_type") == "error").alias("open"))


@query("ledger_reconcile", "SELECT o_custkey % 10 AS model, round(sum(o_totalprice), 2) AS estimated, round(sum(l), 2) AS settled, count_if(l IS NULL) AS unsettled, abs(sum(o_totalprice) - sum(coalesce(l, 0))) / sum(o_totalprice) > 0.5 AS drift FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS l FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey GROUP BY ALL")
def ledger_reconcile(spark, d):
    """AGG33: what calls were thought to cost against what was settled."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("l"))
    j = table(spark, d, "orders").join(li, "o_orderkey", "left")
    e, s = F.sum("o_totalprice"), F.sum(F.coalesce("l", F.lit(0.0)))
    return j.groupBy((F.col("o_custkey") % 10).alias("model")).agg(F.round(e, 2).alias("estimated"), F.round(F.sum("l"), 2).alias("settled"), F.count_if(F.col("l").isNull()).alias("unsettled"), (F.abs(e - s) / e > 0.5).alias("drift"))


@query("budget_utilisation", "WITH b AS (SELECT CAST(ts AS DATE) AS day, round(sum(value) / 2000 * 100, 4) AS pct FROM events GROUP BY ALL) SELECT day, pct, CASE WHEN pct >= 100 THEN 'RED' WHEN pct >= 80 THEN 'YELLOW' ELSE 'GREEN' END AS level FROM b")
def budget_utilisation(spark, d):
    """AGG34."""
    b = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value") / 2000 * 100, 4).alias("pct"))
    return b.select("day", "pct", F.when(F.col("pct") >= 100, "RED").when(F.col("pct") >= 80, "YELLOW").otherwise("GREEN").alias("level"))


@query(
    "model_health",
    "WITH l AS (SELECT user_id, event_type, value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50) SELECT user_id AS model, round(count_if(event_type <> 'error') / count(*), 6) AS success_rate, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS INT) + CASE WHEN floor(count(*) * 0.95) < count(*) THEN 1 ELSE 0 END] AS p95, count(CASE WHEN n <= 5 AND event_type = 'error' THEN 1 END) >= 4 AS circuit_open FROM l GROUP BY ALL",
)
def model_health(spark, d):
    """AGG36: over a model's last fifty calls; each task keeps its own fifty before the shuffle."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = table(spark, d, "events").withColumn("n", n).where("n <= 50")
    at = F.floor(n_() * 0.95)
    p95 = F.element_at(F.sort_array(F.collect_list("value")), (at + F.when(at < n_(), 1).otherwise(0)).cast("int"))
    failed = F.count(F.when((F.col("n") <= 5) & (F.col("event_type") == "error"), 1))
    return last.groupBy(F.col("user_id").alias("model")).agg(F.round(F.count_if(F.col("event_type") != "error") / n_(), 6).alias("success_rate"), p95.alias("p95"), (failed >= 4).alias("circuit_open"))


@query("slo_report", "WITH s AS (SELECT event_type AS slo, count(*) AS n, count_if(value <= 100) / count(*) AS good FROM events GROUP BY ALL), r AS (SELECT slo, n, round(good, 6) AS value, CASE WHEN n < 50 THEN 'NODATA' WHEN good >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS state FROM s) SELECT *, round(count_if(state = 'PASS') OVER () / count(*) OVER (), 6) AS pass_rate FROM r")
def slo_report(spark, d):
    """AGG37 with the pass rate of all."""
    r = table(spark, d, "events").groupBy(F.col("event_type").alias("slo")).agg(n_().alias("n"), (F.count_if(F.col("value") <= 100) / n_()).alias("g"))
    r = r.select("slo", "n", F.round("g", 6).alias("value"), F.when(F.col("n") < 50, "NODATA").when(F.col("g") >= 0.75, "PASS").otherwise("FAIL").alias("state"))
    return r.crossJoin(F.broadcast(r.agg(F.round(F.count_if(F.col("state") == "PASS") / n_(), 6).alias("pass_rate"))))  # one row


@query("dashboard_panels", "SELECT event_type AS panel, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(count(*) / (SELECT date_diff('day', min(ts), max(ts)) + 1 FROM events), 6) AS per_day, count_if(value <= 10) AS le_10, count_if(value <= 50) AS le_50, count_if(value <= 100) AS le_100, count(*) AS le_inf FROM events GROUP BY ALL")
def dashboard_panels(spark, d):
    """AGG39: histogram buckets and the panels drawn from them."""
    e = table(spark, d, "events")
    days = e.agg((F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days"))
    p = X.percentiles(e.withColumnRenamed("event_type", "panel"), ["panel"], "value", {"p95": 0.95, "p99": 0.99}).withColumns({"p95": F.round("p95", 4), "p99": F.round("p99", 4)})
    g = e.groupBy(F.col("event_type").alias("panel")).agg(*(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (10, 50, 100)), n_().alias("le_inf")).join(p, "panel")
    return g.crossJoin(F.broadcast(days)).withColumn("per_day", F.round(F.col("le_inf") / F.col("days"), 6)).drop("days")


@query("source_inventory", "SELECT source AS source_key, string_agg(version || ':' || n, ',' ORDER BY version) AS versions, max(version) AS current_version, CAST(sum(n) AS BIGINT) AS chunks FROM (SELECT source, doc_id % 4 AS version, count(*) AS n FROM documents GROUP BY ALL) GROUP BY ALL")
def source_inventory(spark, d):
    """AGG40: the versions of each source with their chunks, and the current one."""
    v = table(spark, d, "documents").groupBy("source", (F.col("doc_id") % 4).alias("version")).agg(n_().alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "n"))), lambda x: F.concat(x["version"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return v.groupBy(F.col("source").alias("source_key")).agg(listed.alias("versions"), F.max("version").alias("current_version"), F.sum("n").alias("chunks"))


#: Each document under a title, its paragraphs as sections, items, quotes, code and table rows in turn.
_MARKDOWN = S.Derived("SELECT doc_id, '# ' || source || chr(10) || replace(replace(replace(replace(text, '#', ''), '|', ''), '`', ''), chr(10), chr(10) || CASE doc_id % 6 WHEN 0 THEN '## ' WHEN 1 THEN '- ' WHEN 2 THEN '> ' WHEN 3 THEN '### ' ELSE '' END) || CASE WHEN doc_id % 6 = 4 THEN chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' ELSE '' END AS text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
_LINE = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS n FROM " + _MARKDOWN.sql + ")"


@query(
    "markdown_sections",
    rf"""WITH k AS (SELECT *, CASE WHEN doc_id % 6 = 4 AND line_no >= n - 3 THEN 'code' WHEN trim(l) = '' THEN 'blank' WHEN regexp_matches(l, '^#{{1,6}}\s+\S') THEN 'heading' WHEN regexp_matches(l, '^\s*([-*+]|\d+[.)])\s+') THEN 'list' WHEN regexp_matches(l, '^\s*>') THEN 'quote' ELSE 'paragraph' END AS kind FROM {_LINE})
SELECT doc_id, kind, count(*) AS lines, md5(string_agg(l, chr(10) ORDER BY line_no)) AS lines_md5 FROM k WHERE kind <> 'blank' GROUP BY ALL""",
)
def markdown_sections(spark, d):
    """SRC3: the lines of each kind in Markdown made of the documents; sections and paths are tested on their own."""
    return parsers.markdown_lines(_MARKDOWN.df(spark, d)).where("kind <> 'blank'").groupBy("doc_id", "kind").agg(n_().alias("lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "\n")).alias("lines_md5"))


@query("normalised_texts", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5, len(list_filter(string_split(regexp_replace(text, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences FROM documents WHERE text IS NOT NULL")
def normalised_texts(spark, d):
    """DOC1 and DOC4."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("text_md5"), F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


_FORM = S_._canonical("t")


@query("compatible_fingerprints", f"SELECT key, {K._norm(_FORM)} AS fingerprint FROM (SELECT key, {S_._clean('text')} AS t FROM {S_.PROMPTS.sql})")
def compatible_fingerprints(spark, d):
    """DOC2: fingerprints over Unicode's compatibility form."""
    return S_.PROMPTS.df(spark, d).select("key", L.plain(F.coalesce(Y.canonical(F.col("text")), F.lit(""))).alias("fingerprint"))


@query("embedding_hashes", "SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda v: format('{:.6f}', CAST(v AS DOUBLE))), ',')) AS embedding_hash FROM embeddings")
def embedding_hashes(spark, d):
    """SCL1: vectors by six decimals of all their numbers."""
    return table(spark, d, "embeddings").select("vec_id", F.sha2(V.six_decimals(F.col("embedding")), 256).alias("embedding_hash"))


#: Embeddings as stored texts, some broken.
_VECTORS = S.Derived("SELECT vec_id AS id, CASE vec_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '[1, \"x\"]' WHEN 2 THEN 'not json ' || vec_id WHEN 3 THEN '[]' ELSE '[' || vec_id || ', -0.5, ' || label || 'e-1, ' || (vec_id % 10) || '.25]' END AS raw FROM embeddings")


@query("vector_parse", "SELECT vec_id AS id, CAST(CASE vec_id % 7 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE 4 END AS INT) AS n, round(CAST(CASE vec_id % 7 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE vec_id - 0.5 + label / 10.0 + vec_id % 10 + 0.25 END AS DOUBLE), 6) AS total FROM embeddings")
def vector_parse(spark, d):
    """SCL16: stored vectors are taken only if all of them are numbers; the SQL works their sums out from the columns they were made of."""
    v = V.parse_embedding(F.col("raw"))
    return _VECTORS.df(spark, d).select("id", F.coalesce(F.size(v), F.lit(-1)).alias("n"), F.coalesce(F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6), F.lit(-1.0)).alias("total"))


_KEYS = S.Derived("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(lang) || ':' || source || ':' || (doc_id % 3) || ':' || doc_id WHEN 1 THEN upper(lang) || ':' || source || ':x:' || doc_id WHEN 2 THEN source || ':' || lang WHEN 3 THEN lang || ':b:1:' || doc_id || ':3' ELSE '' END AS k FROM documents")


@query("stable_key_parse", f"SELECT doc_id, CASE WHEN len(p) = 4 THEN p[1] END AS domain, CASE WHEN len(p) = 4 THEN p[2] END AS source_key, CASE WHEN len(p) = 4 THEN TRY_CAST(p[3] AS INT) END AS version, CASE WHEN len(p) = 4 THEN TRY_CAST(p[4] AS INT) END AS source_index FROM (SELECT doc_id, string_split(k, ':') AS p FROM {_KEYS.sql})")
def stable_key_parse(spark, d):
    """SCL4."""
    return _KEYS.df(spark, d).select("doc_id", T.parse_stable_key(F.col("k")).alias("p")).select("doc_id", "p.*")


@query(
    "acl_drift_reasons",
    f"WITH {S.bm25()}, t AS ({S.top('bm25', 10)}) SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.doc_id % 7 = 3 THEN 'workspace' WHEN d.doc_id % 3 = 0 THEN 'organization' WHEN d.doc_id % 13 = 0 THEN 'unpublished' WHEN d.doc_id % 11 = 0 OR d.doc_id % 4 = 3 THEN 'classification' WHEN d.doc_id % 2 = 1 THEN 'generation' ELSE 'kept' END AS reason, count(*) AS hits FROM t LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 17 <> 0) d USING (doc_id) GROUP BY ALL",
)
def acl_drift_reasons(spark, d):
    """FLT7: hits of an index checked again against the corpus, the first reason to drop each."""
    t = R.top_k(R.bm25(table(spark, d, "documents"), items(spark, d)), 10).select("doc_id")
    j = t.join(table(spark, d, "documents").where("doc_id % 17 <> 0").select("doc_id", F.lit(True).alias("there")), "doc_id", "left")
    k = F.col("doc_id")
    reason = F.when(F.col("there").isNull(), "missing").when(k % 7 == 3, "workspace").when(k % 3 == 0, "organization").when(k % 13 == 0, "unpublished").when((k % 11 == 0) | (k % 4 == 3), "classification").when(k % 2 == 1, "generation").otherwise("kept")
    return j.groupBy(reason.alias("reason")).agg(n_().alias("hits"))


@query("source_lookup", "SELECT doc_id, lang, length(text) AS n FROM documents WHERE source = 'src3' ORDER BY doc_id")
def source_lookup(spark, d):
    """FLT9: an allow-listed template with a parameter, never with text put into it."""
    return spark.sql("SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n FROM {docs} WHERE source = :source", docs=table(spark, d, "documents"), args={"source": "src3"})


@query("forbidden_pairs", f"WITH {S.bm25()}, t AS ({S.top('bm25', 10)}) SELECT query_id, doc_id FROM t WHERE NOT ((query_id + doc_id) % 9 = 0)")
def forbidden_pairs(spark, d):
    """FLT14: evidence that is forbidden for a query, by the pair of both."""
    t = R.top_k(R.bm25(table(spark, d, "documents"), items(spark, d)), 10).select("query_id", "doc_id")
    bad = t.where((F.col("query_id") + F.col("doc_id")) % 9 == 0)
    return t.join(bad, ["query_id", "doc_id"], "left_anti")


@query("children_by_domain", "SELECT o_orderstatus AS domain, count(*) AS children, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL")
def children_by_domain(spark, d):
    """JN1: children joined to their reports, filtered by the report's domain."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("domain"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(o, "l_orderkey").groupBy("domain").agg(n_().alias("children"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
