"""Queries of the retrieval operators: the benchmark's items are the query set, documents and embeddings the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import chunking as C
from lodestone.operators import near_duplicates
from lodestone.operators import retrieval as R
from lodestone.plans import registry as S
from lodestone.plans.registry import query, table


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def lexical_run(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return R.top_k(R.bm25(docs(spark, d), items(spark, d)), k)


def cosine_run(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return R.top_k(R.token_cosine(docs(spark, d), items(spark, d)), k)


BM, CO = f"{S.bm25()}, bm AS ({S.top('bm25', 10)})", f"{S.COSINE}, co AS ({S.top('tc', 10)})"


@query("bm25_topk", f"WITH {BM} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark, d):
    return lexical_run(spark, d).select("query_id", "doc_id", "score", "rank")


@query("bm25_term_set", f"WITH {S.bm25(boost=False, least=1.0)}, r AS ({S.top('bm25', 5)}) SELECT query_id, doc_id, score, rank FROM r")
def bm25_term_set(spark, d):
    return R.top_k(R.bm25(docs(spark, d), items(spark, d), boost=False, least_avgdl=1.0), 5).select("query_id", "doc_id", "score", "rank")


@query("bm25_scoped", f"WITH {S.bm25(docs='SELECT doc_id, text FROM documents WHERE doc_id % 3 = 1 AND doc_id % 4 * 10 <= 20')}, r AS ({S.top('bm25', 10)}) SELECT query_id, doc_id, score, rank FROM r")
def bm25_scoped(spark, d):
    scoped = docs(spark, d).where((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 4 * 10 <= 20))  # statistics are those of the scope
    return R.top_k(R.bm25(scoped, items(spark, d)), 10).select("query_id", "doc_id", "score", "rank")


_TITLE = "regexp_extract(text, '^[^\\n]*')"


@query(
    "multi_match_fields",
    f"""WITH {S.bm25(docs=f"SELECT doc_id, {_TITLE} AS text FROM documents", name="bt")}, {S.bm25(docs="SELECT doc_id, source || ' ' || lang AS text FROM documents", name="bs")}, {S.bm25(name="bc")},
u AS (SELECT query_id, doc_id, 5 * score AS score FROM bt UNION ALL SELECT query_id, doc_id, 4 * score FROM bs UNION ALL SELECT * FROM bc),
m AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM u GROUP BY ALL), r AS ({S.top('m', 10)}) SELECT query_id, doc_id, score, rank FROM r""",
)
def multi_match_fields(spark, d):
    own, q = docs(spark, d), items(spark, d)
    fields = ((5, F.regexp_extract("text", "^[^\\n]*", 0)), (4, F.concat_ws(" ", "source", "lang")), (1, F.col("text")))
    out = None
    for weight, field in fields:
        run = R.bm25(own.select("doc_id", field.alias("text")), q).withColumn("score", F.col("score") * weight)
        out = run if out is None else out.unionByName(run)
    return R.top_k(out.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score")), 10)


@query("token_cosine_topk", f"WITH {CO} SELECT query_id, doc_id, score, rank FROM co")
def token_cosine_topk(spark, d):
    return cosine_run(spark, d).select("query_id", "doc_id", "score", "rank")


_COVER = f"len(list_intersect(list_distinct({S.tokens('query')}), {S.tokens('text')})) / len(list_distinct({S.tokens('query')}))"
_PHRASE = f"CASE WHEN contains(regexp_replace(lower(text), '\\s+', '', 'g'), regexp_replace(lower(query), '\\s+', '', 'g')) THEN 1.0 ELSE {S.keyword('query', 'text')} END"


@query(
    "lexical_rerank",
    f"""WITH {BM}, {S.COSINE}, f AS (SELECT bm.query_id, bm.doc_id, bm.score AS base, coalesce(tc.score, 0) AS cosine, {S.keyword('b.text', 'documents.text')} AS keyword,
  {_COVER.replace('(query)', '(b.text)').replace('(text)', '(documents.text)')} AS coverage, {_PHRASE.replace('(query)', '(b.text)').replace('(text)', '(documents.text)')} AS phrase
  FROM bm JOIN benchmark b ON b.item_id = bm.query_id JOIN documents USING (doc_id) LEFT JOIN tc ON tc.query_id = bm.query_id AND tc.doc_id = bm.doc_id),
s AS (SELECT query_id, doc_id, round(0.55 * base + 0.25 * (0.75 * cosine + 0.25 * keyword) + 0.15 * coverage + 0.05 * phrase, 6) AS score FROM f), r AS ({S.top('s', 10)}) SELECT query_id, doc_id, score, rank FROM r""",
)
def lexical_rerank(spark, d):
    own, q = docs(spark, d), items(spark, d)
    run = lexical_run(spark, d).select("query_id", "doc_id", F.col("score").alias("base"))
    cos = R.token_cosine(own, q).withColumnRenamed("score", "cosine")
    pairs = R.lexical_features(run.join(R.small(q), "query_id").join(own.select("doc_id", "text"), "doc_id")).join(cos, ["query_id", "doc_id"], "left")
    lexical = 0.75 * F.coalesce("cosine", F.lit(0.0)) + 0.25 * F.col("keyword")
    return R.top_k(pairs.select("query_id", "doc_id", F.round(R.rerank_score(F.col("base"), lexical, F.col("coverage"), F.col("phrase")), 6).alias("score")), 10)


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_KNN = f"""v AS (SELECT vec_id, label, {_D} AS v FROM embeddings), kn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label AS ql, b.label AS dl,
  round(1 / (1 + greatest(0, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


def vector_run(spark, d, k=10):
    index = table(spark, d, "embeddings")
    return R.knn(index, index.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)


@query("knn_topk", f"WITH {_KNN}, r AS ({S.top('kn', 10)}) SELECT query_id, doc_id, score, rank FROM r")
def knn_topk(spark, d):
    return vector_run(spark, d).select("query_id", "doc_id", "score", "rank")


@query("knn_filtered", f"WITH {_KNN}, f AS (SELECT * FROM kn WHERE dl <= 4), r AS ({S.top('f', 5)}) SELECT query_id, doc_id, score, rank FROM r")
def knn_filtered(spark, d):
    index = table(spark, d, "embeddings")
    near = index.where("label <= 4")  # the filter comes before top-k
    return R.knn(near, index.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)


def _minmax(run: str) -> str:
    return f"SELECT query_id, doc_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {run})"


@query(
    "weighted_fusion",
    f"""WITH {BM}, {CO}, a AS ({_minmax('co')}), b AS ({_minmax('bm')}), f AS (SELECT query_id, doc_id, a.s AS sa, b.s AS sb, count(a.s) OVER (PARTITION BY query_id) AS na, count(b.s) OVER (PARTITION BY query_id) AS nb FROM a FULL JOIN b USING (query_id, doc_id)),
s AS (SELECT query_id, doc_id, round((CASE WHEN na > 0 THEN 0.2 ELSE 0 END * coalesce(sa, 0) + CASE WHEN nb > 0 THEN 0.8 ELSE 0 END * coalesce(sb, 0)) / (CASE WHEN na > 0 THEN 0.2 ELSE 0 END + CASE WHEN nb > 0 THEN 0.8 ELSE 0 END), 6) AS score FROM f),
r AS ({S.top('s', 10)}) SELECT query_id, doc_id, score, rank FROM r""",
)
def weighted_fusion(spark, d):
    return R.top_k(R.weighted_fusion(cosine_run(spark, d), lexical_run(spark, d)), 10)


@query(
    "rrf_fusion",
    f"WITH {BM}, {CO}, u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM bm UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM co), f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM u GROUP BY ALL), r AS ({S.top('f', 20)}) SELECT query_id, doc_id, score, rank FROM r",
)
def rrf_fusion(spark, d):
    return R.top_k(R.rrf([lexical_run(spark, d), cosine_run(spark, d)], [1.0, 0.5]), 20)


@query(
    "naive_interleave",
    f"WITH {BM}, {CO}, u AS (SELECT query_id, doc_id, 2 * rank AS p FROM bm UNION ALL SELECT query_id, doc_id, 2 * rank + 1 FROM co), f AS (SELECT query_id, doc_id, min(p) AS p FROM u GROUP BY ALL) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) AS INT) AS rank FROM f QUALIFY rank <= 10",
)
def naive_interleave(spark, d):
    return R.interleave([lexical_run(spark, d), cosine_run(spark, d)], 10)


@query("substring_baseline", "SELECT item_id AS query_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS INT) AS rank FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) QUALIFY rank <= 5")
def substring_baseline(spark, d):
    hits = R.containing(docs(spark, d).select("doc_id", "text"), items(spark, d))
    return R.top_k(hits.withColumn("score", F.lit(0)), 5).select("query_id", "doc_id", "rank")


@query(
    "exact_dedupe_aliases",
    f"""WITH {BM}, f AS (SELECT bm.query_id, bm.doc_id, bm.rank, sha256({S.form('documents.text')}) AS f FROM bm JOIN documents USING (doc_id)), g AS (SELECT *, rank = min(rank) OVER (PARTITION BY query_id, f) AS best FROM f)
SELECT query_id, arg_min(doc_id, rank) AS doc_id, min(rank) AS rank, array_to_string(list_sort(list(doc_id ORDER BY doc_id) FILTER (WHERE NOT best)), ',') AS equivalent_keys FROM g GROUP BY query_id, f""",
)
def exact_dedupe_aliases(spark, d):
    out = R.collapse_duplicates(lexical_run(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id"))
    return out.withColumn("equivalent_keys", F.when(F.size("equivalent_keys") > 0, F.array_join(F.transform("equivalent_keys", lambda x: x.cast("string")), ",")))


@query(
    "diversity_cap",
    f"WITH {S.bm25()}, s AS (SELECT query_id, doc_id, score, source FROM (SELECT bm25.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS g FROM bm25 JOIN documents USING (doc_id)) WHERE g <= 2), r AS ({S.top('s', 10)}) SELECT query_id, doc_id, source, score, rank FROM r",
)
def diversity_cap(spark, d):
    run = R.bm25(docs(spark, d), items(spark, d)).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return R.diversity_cap(run, "source", 2, 10).select("query_id", "doc_id", "source", "score", "rank")


_CHUNKS = f"SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(t, 1 + i * 448, 512) AS content FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 447) // 448)) AS i FROM (SELECT doc_id, {S.collapsed('text')} AS t FROM documents))"


@query(
    "neighbour_expand",
    f"WITH c AS ({_CHUNKS}), h AS (SELECT doc_id, chunk_index FROM c WHERE chunk_index % 3 = 1) SELECT h.doc_id AS query_id, h.chunk_index AS hit_index, md5(string_agg(c.content, chr(10) || chr(10) ORDER BY c.chunk_index)) AS content_md5, count(*) AS n_chunks FROM h JOIN c ON c.doc_id = h.doc_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY ALL",
)
def neighbour_expand(spark, d):
    chunks = C.fixed_windows(docs(spark, d)).select(F.col("doc_id").alias("source_key"), F.lit(1).alias("version"), F.col("chunk_index").alias("source_index"), "content")
    hits = chunks.where("source_index % 3 = 1").select(F.col("source_key").alias("query_id"), "source_key", "version", "source_index")
    return R.expand_neighbours(chunks, hits).select("query_id", "hit_index", F.md5("content").alias("content_md5"), "n_chunks")


@query(
    "evidence_merge",
    f"""WITH {BM}, {CO}, u AS (SELECT query_id, doc_id, score FROM bm UNION ALL SELECT query_id, doc_id, 10 * score FROM co), b AS (SELECT query_id, doc_id, max(score) AS raw FROM u GROUP BY ALL),
s AS (SELECT query_id, doc_id, source, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0 ELSE round(0.1 + (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) * 0.9, 4) END AS score FROM b JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, source, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) <= 2""",
)
def evidence_merge(spark, d):
    both = lexical_run(spark, d).select("query_id", "doc_id", "score").unionByName(cosine_run(spark, d).select("query_id", "doc_id", (10 * F.col("score")).alias("score")))
    return R.merge_evidence(both.join(docs(spark, d).select("doc_id", "source"), "doc_id"), cap=2).select("query_id", "doc_id", "source", "score")


_SC = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN 1.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@query(
    "rerank_blend",
    f"""WITH {BM}, {S.COSINE}, p AS (SELECT bm.query_id, bm.doc_id, bm.score AS base, coalesce(tc.score, 0) AS rerank FROM bm LEFT JOIN tc USING (query_id, doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, doc_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, doc_id) AS rb FROM p)
SELECT query_id, doc_id, 'pure' AS mode, rerank AS score FROM p UNION ALL SELECT query_id, doc_id, 'rrf', round(1.0 / (60 + ra) + 1.0 / (60 + rb), 6) FROM o
UNION ALL SELECT query_id, doc_id, 'alpha', round(0.5 * ({_SC.format('rerank')}) + 0.5 * ({_SC.format('base')}), 6) FROM p WINDOW w AS (PARTITION BY query_id)""",
)
def rerank_blend(spark, d):
    cos = R.token_cosine(docs(spark, d), items(spark, d)).withColumnRenamed("score", "rerank")
    run = lexical_run(spark, d).withColumnRenamed("score", "base").join(cos, ["query_id", "doc_id"], "left").fillna(0.0, ["rerank"])
    out = None
    for mode in ("pure", "rrf", "alpha"):
        part = R.blend(run, mode).select("query_id", "doc_id", F.lit(mode).alias("mode"), "score")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "shadow_compare",
    f"WITH {BM}, {CO} SELECT query_id, count(bm.rank) AS n_serving, count(co.rank) AS n_candidate, count_if(bm.rank IS NOT NULL AND co.rank IS NOT NULL) AS overlap, bool_or(bm.rank IS NULL OR co.rank IS NULL) AS ranking_changed FROM bm FULL JOIN co USING (query_id, doc_id) GROUP BY ALL",
)
def shadow_compare(spark, d):
    a, b = (r.select("query_id", "doc_id", F.col("rank").alias(n)) for r, n in ((lexical_run(spark, d), "x"), (cosine_run(spark, d), "y")))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return a.join(b, ["query_id", "doc_id"], "full").groupBy("query_id").agg(F.count("x").alias("n_serving"), F.count("y").alias("n_candidate"), F.count_if(both).alias("overlap"), F.bool_or(~both).alias("ranking_changed"))


@query(
    "query_decompose",
    r"WITH p AS (SELECT item_id AS query_id, list_filter(list_transform(regexp_split_to_array(text, '[?？;；]|并且|以及|同时|\s+and\s+|\s+then\s+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM benchmark) SELECT query_id, CAST(unnest(range(1, len(parts) + 1)) AS INT) AS part_no, unnest(parts) AS part, CASE WHEN len(parts) > 1 THEN 'multi' ELSE 'single' END AS kind FROM p",
)
def query_decompose(spark, d):
    parts = F.filter(F.transform(F.split("query", r"[?？;；]|并且|以及|同时|\s+and\s+|\s+then\s+"), T.collapse), lambda x: x != "")
    split = items(spark, d).select("query_id", parts.alias("parts"))
    return split.select("query_id", F.posexplode("parts").alias("p", "part"), F.when(F.size("parts") > 1, "multi").otherwise("single").alias("kind")).select("query_id", (F.col("p") + 1).alias("part_no"), "part", "kind")


@query("refine_queries", f"SELECT conv_id, array_to_string(list_slice(list_distinct_ordered, 1, 3), '|') AS queries FROM (SELECT conv_id, list(q ORDER BY first_turn) AS list_distinct_ordered FROM (SELECT conv_id, {S.collapsed('text')} AS q, min(turn) AS first_turn FROM conversations WHERE role = 'user' GROUP BY ALL) WHERE q <> '' GROUP BY conv_id)")
def refine_queries(spark, d):
    user = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.collapse(F.col("text")).alias("q")).where("q <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "q"))), lambda x: x["q"])
    return user.groupBy("conv_id").agg(F.array_join(F.slice(F.array_distinct(ordered), 1, 3), "|").alias("queries"))


@query(
    "evidence_critique",
    f"""WITH {BM}, k AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({S.tokens('text')}, lambda t: length(t) >= 4))) AS keyword FROM benchmark),
h AS (SELECT query_id, unnest({S.tokens('documents.text')}) AS keyword FROM bm JOIN documents USING (doc_id) WHERE rank <= 3), m AS (SELECT k.query_id, keyword, (query_id, keyword) IN (SELECT (query_id, keyword) FROM h) AS found FROM k)
SELECT query_id, count(*) AS aspects, count_if(NOT found) AS missing, round(count_if(found) / count(*), 6) AS coverage, CASE WHEN count_if(NOT found) = 0 THEN 'sufficient' WHEN count_if(found) = 0 THEN 'no_evidence' ELSE 'missing_aspects' END AS stop_reason FROM m GROUP BY ALL""",
)
def evidence_critique(spark, d):
    aspects = items(spark, d).select("query_id", F.explode(F.array_distinct(F.filter(T.tokens(F.col("query")), lambda t: F.length(t) >= 4))).alias("keyword"))
    held = lexical_run(spark, d, 3).join(docs(spark, d).select("doc_id", "text"), "doc_id").select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("keyword")).distinct().withColumn("found", F.lit(True))
    joined = aspects.join(held, ["query_id", "keyword"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    n, yes = F.count(F.lit(1)), F.count_if("found")
    return joined.groupBy("query_id").agg(n.alias("aspects"), (n - yes).alias("missing"), F.round(yes / n, 6).alias("coverage"), F.when(yes == n, "sufficient").when(yes == 0, "no_evidence").otherwise("missing_aspects").alias("stop_reason"))


@query("retrieval_cache_keys", f"WITH k AS (SELECT sha256(concat_ws('|', CAST(conv_id % 3 AS VARCHAR), CAST(conv_id % 7 AS VARCHAR), sha256({S.collapsed('lower(text)')}), '10', 'G001')) AS cache_key FROM conversations WHERE role = 'user') SELECT cache_key, count(*) AS lookups, count(*) - 1 AS hits FROM k GROUP BY ALL")
def retrieval_cache_keys(spark, d):
    key = F.sha2(F.concat_ws("|", (F.col("conv_id") % 3).cast("string"), (F.col("conv_id") % 7).cast("string"), F.sha2(T.collapse(F.lower("text")), 256), F.lit("10"), F.lit("G001")), 256)
    return table(spark, d, "conversations").where("role = 'user'").groupBy(key.alias("cache_key")).agg(F.count(F.lit(1)).alias("lookups"), (F.count(F.lit(1)) - 1).alias("hits"))


@query("embedding_cache_reuse", "WITH k AS (SELECT source, sha256('local|hash-8|8|' || text) AS k FROM documents) SELECT source, count(*) AS texts, count(DISTINCT k) AS computed, round(1 - count(DISTINCT k) / count(*), 6) AS reuse_ratio FROM k GROUP BY ALL")
def embedding_cache_reuse(spark, d):
    keyed = docs(spark, d).select("source", F.sha2(F.concat(F.lit("local|hash-8|8|"), F.col("text")), 256).alias("k"))
    n, own = F.count(F.lit(1)), F.count_distinct("k")
    return keyed.groupBy("source").agg(n.alias("texts"), own.alias("computed"), F.round(1 - own / n, 6).alias("reuse_ratio"))


@query("hash_embedding", "SELECT doc_id, round(list_sum(list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INT) / 255 * (i + 1))), 6) AS digest FROM documents")
def hash_embedding(spark, d):
    vector = T.hash_vector(F.col("text"))
    weights = F.array(*(F.lit(float(i)) for i in range(1, 9)))
    return docs(spark, d).select("doc_id", F.round(V.dot(vector, weights), 6).alias("digest"))


@query(
    "multi_source_stats",
    f"WITH {BM}, {CO}, u AS (SELECT 'bm25' AS source_kind, query_id, doc_id, score FROM bm UNION ALL SELECT 'cosine', query_id, doc_id, score FROM co) SELECT source_kind, count(*) AS hits, count(DISTINCT query_id) AS queries, count(DISTINCT doc_id) AS docs, round(max(score), 6) AS best FROM u GROUP BY ALL",
)
def multi_source_stats(spark, d):
    both = lexical_run(spark, d).withColumn("source_kind", F.lit("bm25")).unionByName(cosine_run(spark, d).withColumn("source_kind", F.lit("cosine")))
    return both.groupBy("source_kind").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("query_id").alias("queries"), F.count_distinct("doc_id").alias("docs"), F.round(F.max("score"), 6).alias("best"))


@query("prompt_fields", r"SELECT conv_id, turn, nullif(trim(regexp_extract(text, '^([^.!?\n]*)', 1)), '') AS question, len(regexp_extract_all(text, '[^\n]+')) AS n_contexts FROM conversations WHERE role = 'user'")
def prompt_fields(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.nullif(F.trim(F.regexp_extract("text", r"^([^.!?\n]*)", 1)), F.lit("")).alias("question"), F.size(F.regexp_extract_all("text", F.lit(r"[^\n]+"), F.lit(0))).cast("long").alias("n_contexts"))


@query(
    "near_dup_shingles",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w),
u AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT id, n, unnest(s) AS g FROM u), p AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (g) WHERE a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM p WHERE k / (na + nb - k) >= 0.8""",
)
def near_dup_shingles(spark, d):
    return near_duplicates.pairs(docs(spark, d))


@query(
    "near_dup_members",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s WHERE len(s) > 0""",
)
def near_dup_members(spark, d):
    """JN15: the membership that goes with the pairs of near_dup_shingles."""
    return R.shingle_classes(docs(spark, d))
