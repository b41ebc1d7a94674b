"""Queries of local ranking on titles, sections and generations, multi-hop slots, grounding, and small scorers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fields as L
from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.operators.lexical import bm25_top
from lodestone.plans import registry as S
from lodestone.plans.registry import query, table
from lodestone.streaming.windows import scratch

#: Each document as a chunk: plain, on one line under a title and a section, or under headings; some are of the first or second generation.
CORPUS = S.Derived(
    "SELECT doc_id, coalesce(source, 'none') || CASE WHEN doc_id % 5 = 1 THEN '-g001.' WHEN doc_id % 5 = 2 THEN '-g002.' ELSE '' END || ':' || doc_id || ':1:0' AS chunk_key, lang AS domain, "
    "CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN '# ' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ## ' || split_part(text, ' ', 3) || ' - ' || CASE WHEN doc_id % 5 = 1 THEN '历史版本：' WHEN doc_id % 5 = 2 THEN '当前版本：' ELSE '' END || text "
    "ELSE '# ' || split_part(text, ' ', 1) || chr(10) || '## ' || split_part(text, ' ', 2) || ' -' || chr(10) || text END AS content FROM documents WHERE text IS NOT NULL"
)
#: Questions to every twentieth document: its title, a section or the generation, and its first sentence; some ask for two titles.
ASKED = S.Derived(
    "SELECT doc_id AS query_id, '《' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || '》' || CASE WHEN doc_id % 40 = 0 THEN '中“' || split_part(text, ' ', 3) || '”的要求' ELSE '现行有效规定 G002' END || "
    "CASE WHEN doc_id % 60 = 0 THEN ' 《' || split_part(text, ' ', 4) || '》的“' || split_part(text, ' ', 5) || '”' ELSE '' END || CASE WHEN doc_id % 100 = 20 THEN ' 旧版与现行规定有何不同' ELSE '' END || ' ' || split_part(text, '.', 1) AS query FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0"
)
#: Candidates of each question: the best documents by BM25, which an index gives.
CANDIDATES = 20


def rg(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return rf"list_distinct(list_concat(flatten(list_transform(regexp_extract_all({low}, '[\x{{4e00}}-\x{{9fa5}}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), regexp_extract_all({low}, '[a-z0-9_.\-]+')))"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a}) END)"


_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_PARSED = rf"""(SELECT *, CASE WHEN contains(c, chr(10)) THEN trim(regexp_extract(c, '{L.TITLE}', 1)) ELSE trim(regexp_extract(c, '{L.INLINE}', 1)) END AS title,
CASE WHEN contains(c, chr(10)) THEN list_transform(regexp_extract_all(c, '{L.SECTION}', 1), lambda s: trim(s)) WHEN trim(regexp_extract(c, '{L.INLINE}', 2)) <> '' THEN [trim(regexp_extract(c, '{L.INLINE}', 2))] ELSE [] END AS sections,
regexp_replace(CASE WHEN contains(c, chr(10)) THEN regexp_replace(c, '{L.HEADING}', '', 'g') WHEN regexp_matches(c, '{L.INLINE}') THEN regexp_extract(c, '{L.INLINE}', 3) ELSE c END, '^\s+|\s+$', '', 'g') AS body FROM (SELECT *, coalesce(content, '') AS c FROM {CORPUS.sql}))"""


@query("field_parse", f"SELECT chunk_key, title, array_to_string(sections, '|') AS sections, md5(body) AS body_md5 FROM {_PARSED}")
def field_parse(spark, d):
    """RET24."""
    return CORPUS.df(spark, d).select("chunk_key", L.parse(F.col("content")).alias("f")).select("chunk_key", "f.title", F.array_join("f.sections", "|").alias("sections"), F.md5("f.body").alias("body_md5"))


_G = f"(SELECT *, {rg('title')} AS gt, {rg('body')} AS gb, list_transform(sections, lambda s: {rg('s')}) AS gs, {rg('c')} AS gc FROM {_PARSED})"
_Q = f"(SELECT *, query_id AS parent, {rg('query')} AS q FROM {ASKED.sql})"
_FIELDED = f"5 * {share('q', 'gt')} + 4 * coalesce(list_max(list_transform(gs, lambda s: {share('q', 's')})), 0.0) + {share('q', 'gb')} + CASE WHEN trim(query) <> '' AND (contains(lower(title), lower(trim(query))) OR len(list_filter(sections, lambda s: contains(lower(s), lower(trim(query))))) > 0) THEN 5.0 ELSE 0.0 END"


_CAND = f"{S.bm25(queries=f'SELECT query_id, query FROM {ASKED.sql}', name='cd')}, cand AS (SELECT query_id, doc_id, rank FROM ({S.top('cd', CANDIDATES)}))"


def _candidates(spark, d) -> DataFrame:
    """(query_id, doc_id, rank) of each question's candidates, stored in the shared folder: as small as the questions are many."""
    run = bm25_top(table(spark, d, "documents"), ASKED.df(spark, d), CANDIDATES).select("query_id", "doc_id", "rank")
    run.write.parquet(path := f"{scratch(spark)}/candidates-{uuid.uuid4().hex}")
    return spark.read.parquet(path)


def _joined(spark, d, run: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of a run with their questions and chunks. Chunks are shuffled once, by document; what is scored on them should leave them behind."""
    return CORPUS.df(spark, d).join(R.small(run.join(R.small(asked), "query_id")), "doc_id")


def _pairs(spark, d) -> DataFrame:
    """Each question with its candidates (query_id, query, doc_id, chunk_key, domain, content, rank)."""
    return _joined(spark, d, _candidates(spark, d), ASKED.df(spark, d))


@query("fielded_scores", f"WITH {_CAND} SELECT query_id, chunk_key, round({_FIELDED}, 6) AS score FROM {_Q} JOIN cand USING (query_id) JOIN {_G} USING (doc_id) WHERE round({_FIELDED}, 6) > 0")
def fielded_scores(spark, d):
    """RET23 over the candidates of an index."""
    return _pairs(spark, d).select("query_id", "chunk_key", F.round(L.fielded(F.col("query"), F.col("content")), 6).alias("score")).where("score > 0")


_LOCAL = f"""(SELECT query_id, query, chunk_key, domain, content, round({share('q', 'gc')} + 0.05 * (5 * {share('q', 'gt')} + 4 * {share('q', "coalesce(gs[1], [])")} + CASE WHEN trim(query) <> '' AND contains(lower(c)[1:160], lower(trim(query))) THEN 2.0 ELSE 0.0 END)
+ CASE WHEN titled THEN 8.0 ELSE 0.0 END + CASE WHEN titled AND len(list_filter(regexp_extract_all(query, '{L.QUOTE}', 1), lambda t: trim(t) <> '' AND (contains(coalesce(sections[1], ''), trim(t)) OR contains(body, trim(t))))) > 0 THEN 6.0 ELSE 0.0 END
+ CASE WHEN len(list_filter(regexp_extract_all(lower(query), '{L.GENERATION}'), lambda g: contains(lower(chunk_key), g) OR contains(lower(c), g))) > 0 THEN 8.0 ELSE 0.0 END, 6) AS score
FROM (SELECT *, len(list_filter(regexp_extract_all(query, '{L.ASPECT}', 1), lambda t: trim(t) <> '' AND contains(title, trim(t)))) > 0 AS titled FROM <q> JOIN (SELECT query_id AS parent, doc_id FROM cand) USING (parent) JOIN {_G} USING (doc_id)))"""


def _local(spark, pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.round(L.local_score(F.col("query"), F.col("chunk_key"), F.col("content")), 6))


@query("local_retrieval", f"WITH {_CAND} SELECT query_id, chunk_key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS INT) AS rank FROM {_LOCAL.replace('<q>', _Q)} WHERE score > 0 QUALIFY rank <= 5")
def local_retrieval(spark, d):
    """RET21; ties by key (SRT1)."""
    s = _local(spark, _pairs(spark, d)).where("score > 0").select("query_id", F.col("chunk_key").alias("doc_id"), "score")
    return R.top_k(s, 5).withColumnRenamed("doc_id", "chunk_key")


_HOPS = f"(SELECT query_id * 10 + i AS query_id, query_id AS parent, i, a AS query, {rg('a')} AS q FROM (SELECT query_id, unnest(range(1, len(t) + 1)) AS i, unnest(list_transform(list_zip(t, m), lambda p: trim(trim(p[1]) || ' ' || trim(p[2])))) AS a FROM (SELECT query_id, regexp_extract_all(query, '{L.ASPECT}', 1) AS t, regexp_extract_all(query, '{L.ASPECT}', 2) AS m FROM {ASKED.sql}) WHERE len(t) >= 2))"


@query(
    "multi_hop_slots",
    f"""WITH {_CAND}, a AS (SELECT h.parent, h.i, l.chunk_key, l.score, row_number() OVER (PARTITION BY l.query_id ORDER BY l.score DESC, l.chunk_key) AS r FROM {_LOCAL.replace('<q>', _HOPS)} l JOIN {_HOPS} h ON h.query_id = l.query_id WHERE l.score > 0),
g AS (SELECT query_id AS parent, chunk_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS r FROM {_LOCAL.replace('<q>', _Q)} WHERE score > 0),
u AS (SELECT parent, chunk_key, i * 100 + r AS place FROM a WHERE r <= 2 UNION ALL SELECT parent, chunk_key, 10000 + r FROM g WHERE parent IN (SELECT parent FROM a)), m AS (SELECT parent, chunk_key, min(place) AS place FROM u GROUP BY ALL)
SELECT parent AS query_id, chunk_key, CAST(row_number() OVER (PARTITION BY parent ORDER BY place) AS INT) AS rank FROM m QUALIFY rank <= 5""",
)
def multi_hop_slots(spark, d):
    """RET22: the two best of each aspect that the query names keep a place, the whole query fills up. Aspects here share no evidence."""
    run = _candidates(spark, d)
    parts = F.arrays_zip(F.regexp_extract_all("query", F.lit(L.ASPECT), F.lit(1)).alias("t"), F.regexp_extract_all("query", F.lit(L.ASPECT), F.lit(2)).alias("m"))
    hops = ASKED.df(spark, d).select("query_id", F.posexplode(parts).alias("i", "p"), F.size(parts).alias("n")).where("n >= 2").select("query_id", "i", F.trim(F.concat(F.trim("p.t"), F.lit(" "), F.trim("p.m"))).alias("query"))
    a = _local(spark, _joined(spark, d, run, hops)).where("score > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id", "i").orderBy(F.desc("score"), "chunk_key"))).where("r <= 2")
    g = _local(spark, _joined(spark, d, run, ASKED.df(spark, d))).where("score > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_key")))
    several = a.select("query_id").distinct()
    u = a.select("query_id", "chunk_key", ((F.col("i") + 1) * 100 + F.col("r")).alias("place")).unionByName(g.join(several, "query_id", "left_semi").select("query_id", "chunk_key", (10_000 + F.col("r")).alias("place")))
    m = u.groupBy("query_id", "chunk_key").agg(F.min("place").alias("place"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where("rank <= 5").select("query_id", "chunk_key", "rank")


@query(
    "fielded_rerank",
    f"""WITH {_CAND}, s AS (SELECT query_id, chunk_key, {_FIELDED} AS f, rank AS i FROM {_Q} JOIN cand USING (query_id) JOIN {_G} USING (doc_id)), w AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, min(f) OVER (PARTITION BY query_id) AS lo, max(f) OVER (PARTITION BY query_id) AS hi FROM s)
SELECT query_id, chunk_key, round(0.5 * CASE WHEN hi > lo THEN (f - lo) / (hi - lo) ELSE 0 END + 0.35 * (n - i + 1) / n, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * CASE WHEN hi > lo THEN (f - lo) / (hi - lo) ELSE 0 END + 0.35 * (n - i + 1) / n, 6) DESC, i) AS INT) AS rank FROM w""",
)
def fielded_rerank(spark, d):
    """RET25, WIN11 and SRT2: fielded scores scaled within a query's candidates, with a prior by place; ties keep the order of arrival."""
    run = _pairs(spark, d).withColumn("fielded", L.fielded(F.col("query"), F.col("content")))
    scored = R.fielded_rerank(run).withColumnRenamed("rank", "i")
    return scored.select("query_id", "chunk_key", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "i")).alias("rank"))


def _norm(x: str) -> str:
    return rf"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g')"


def _bi(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


# How queries ask for the present rule or compare it with an older one, and how chunks say which they are.
_OLD_WORDS, _NEW_WORDS, _CURRENT = ("旧版", "历史", "已废止", "原规定"), ("当前", "现行", "有效", "新版本"), ("当前", "现行", "有效规定", "G002")


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _best(expected: str, actual: str) -> str:
    exact = f"coalesce(list_max(list_transform({expected}, lambda v: CASE WHEN {_norm('v')} = '' THEN 0.0 WHEN {_norm('v')} = {_norm(actual)} THEN 1.0 WHEN contains({_norm(actual)}, {_norm('v')}) OR contains({_norm('v')}, {_norm(actual)}) THEN 0.7 ELSE 0.0 END)), 0.0)"
    cover = f"coalesce(list_max(list_transform({expected}, lambda v: {share(_bi(_norm('v')), _bi(_norm(actual)))})), 0.0)"
    return exact, cover


_TE, _TC = _best("et", "ti")
_SE, _SC = _best("es", "se")
_HEAD = r"(?s)^#\s*(.*?)\s*##\s*(.*?)(?:\s+-\s+|$)"


@query(
    "metadata_rank",
    rf"""WITH {_CAND}, h AS (SELECT query_id, query, chunk_key, content, rank AS r FROM {ASKED.sql} JOIN cand USING (query_id) JOIN {CORPUS.sql} USING (doc_id)),
f AS (SELECT *, regexp_extract_all(query, '{L.BOOK}', 1) AS et, regexp_extract_all(query, '[“"]([^”"]+)[”"]', 1) AS es, CASE WHEN regexp_matches(content, '{_HEAD}') THEN trim(regexp_extract(content, '{_HEAD}', 1)) ELSE trim(regexp_extract(content, '(?m)^#\s+(.+)$', 1)) END AS ti, CASE WHEN regexp_matches(content, '{_HEAD}') THEN trim(regexp_extract(content, '{_HEAD}', 2)) ELSE '' END AS se,
({_any('query', _OLD_WORDS)} AND {_any('query', _NEW_WORDS)}) OR contains(query, '冲突') AS compares FROM h),
s AS (SELECT *, 12 * {_TE} + 8 * {_SE} + 4 * {_TC} + 3 * {_SC} + 10 * CASE WHEN compares OR NOT {_any('query', _CURRENT)} THEN 0.0 WHEN contains(content, '当前版本') OR contains(content, '现行版本') OR contains(lower(chunk_key), '-g002.') THEN 1.0 WHEN contains(content, '历史版本') OR contains(content, '已被 G002 替代') OR contains(lower(chunk_key), '-g001.') THEN -1.0 ELSE 0.0 END + 2 / log2(greatest(2, r + 1)) AS sc FROM f)
SELECT query_id, chunk_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r > 8, CASE WHEN r <= 8 AND NOT compares THEN -round(sc, 6) ELSE 0 END, r) AS INT) AS rank FROM s""",
)
def metadata_rank(spark, d):
    """RET26: the first eight of a list by title, section, version and place; queries that compare versions keep their order, the tail always does."""
    q, c = F.col("query"), F.col("content")
    h = _pairs(spark, d).withColumnRenamed("rank", "r")

    def some(x: Column, words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | x.contains(w)
        return out

    def best(expected: Column, actual: Column) -> tuple[Column, Column]:
        a = L.plain(actual)

        def one(v: Column) -> Column:
            n = L.plain(v)
            return F.when(n == "", 0.0).when(n == a, 1.0).when(a.contains(n) | n.contains(a), 0.7).otherwise(0.0)

        return F.coalesce(F.array_max(F.transform(expected, one)), F.lit(0.0)), F.coalesce(F.array_max(F.transform(expected, lambda v: L.overlap(L.pairs(L.plain(v)), L.pairs(a)))), F.lit(0.0))

    inline = c.rlike(_HEAD)
    h = h.withColumns({
        "ti": F.when(inline, F.trim(F.regexp_extract(c, _HEAD, 1))).otherwise(F.trim(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1))), "se": F.when(inline, F.trim(F.regexp_extract(c, _HEAD, 2))).otherwise(""),
        "et": F.regexp_extract_all(q, F.lit(L.BOOK), F.lit(1)), "es": F.regexp_extract_all(q, F.lit(r"[“\"]([^”\"]+)[”\"]"), F.lit(1)), "compares": some(q, _OLD_WORDS) & some(q, _NEW_WORDS) | q.contains("冲突"),
    })
    (te, tc), (se, sc) = best(F.col("et"), F.col("ti")), best(F.col("es"), F.col("se"))
    key = F.lower("chunk_key")
    version = F.when(F.col("compares") | ~some(q, _CURRENT), 0.0).when(c.contains("当前版本") | c.contains("现行版本") | key.contains("-g002."), 1.0).when(c.contains("历史版本") | c.contains("已被 G002 替代") | key.contains("-g001."), -1.0).otherwise(0.0)
    score = F.round(12 * te + 8 * se + 4 * tc + 3 * sc + 10 * version + 2 / F.log2(F.greatest(F.lit(2), F.col("r") + 1)), 6)
    h = h.withColumn("s", F.when((F.col("r") <= 8) & ~F.col("compares"), -score).otherwise(0.0))
    return h.select("query_id", "chunk_key", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("r") > 8, "s", "r")).alias("rank"))


def bigrams(x: Column) -> Column:
    """Overlapping pairs of letters, digits and Chinese characters within words, as an n-gram full-text index cuts them."""
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: T.char_grams(w, 2)))


def _bigrams_sql(x: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]{{2,}}'), lambda w: list_transform(range(1, length(w)), lambda i: substr(w, i, 2))))"


@query("fulltext_2gram", f"WITH {S.bm25(name='ft', tok=_bigrams_sql)} SELECT query_id, doc_id, score, rank FROM ({S.top('ft', 10)})")
def fulltext_2gram(spark, d):
    """RET4: BM25 over pairs of characters, the terms of an n-gram full-text index."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.top_k(R.bm25(table(spark, d, "documents"), items, tokenise=bigrams), 10)


#: Assistants' turns as answers, the turn before as evidence; some have none.
_ANSWERS = S.Derived(
    "SELECT a.conv_id * 1000 + a.turn AS answer_id, a.text AS answer, CASE WHEN a.turn % 4 = 3 OR u.text IS NULL THEN filter_none ELSE ARRAY(u.text, split_part(a.text, '.', 1)) END AS evidence FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND a.text IS NOT NULL".replace("filter_none", "ARRAY()")
)
_ALNUM = r"[^\p{L}\p{N}]+"


@query(
    "groundedness",
    rf"""WITH c AS (SELECT answer_id, evidence, unnest(list_filter(list_transform(regexp_split_to_array(answer, '[。！？!?；;\.\n]+'), lambda s: trim(s)), lambda s: length(regexp_replace(s, '{_ALNUM}', '', 'g')) >= 5)) AS claim FROM {_ANSWERS.sql}),
s AS (SELECT answer_id, len(list_filter(evidence, lambda b: len(list_filter(list_filter(regexp_split_to_array(lower(claim), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1), lambda t: contains(lower(b), t))) > 0)) > 0
OR (array_to_string(evidence, '') <> '' AND {share(_bi(f"regexp_replace(lower(claim), '{_ALNUM}', '', 'g')"), _bi(f"regexp_replace(lower(array_to_string(evidence, '')), '{_ALNUM}', '', 'g')"))} >= 0.48) AS ok FROM c)
SELECT answer_id, coalesce(n, 0) AS claims, round(coalesce(v / n, 0), 3) AS coverage, CASE WHEN n > 0 AND v / n >= 0.6 THEN 'supported' WHEN len(evidence) = 0 THEN 're_retrieve' ELSE 'revise' END AS decision FROM {_ANSWERS.sql} LEFT JOIN (SELECT answer_id, count(*) AS n, count_if(ok) AS v FROM s GROUP BY ALL) USING (answer_id)""",
)
def groundedness(spark, d):
    """RET41: an answer's claims against its evidence, by a keyword in one piece or by 48 % of a claim's pairs in all of it."""
    bare = lambda x: F.regexp_replace(F.lower(x), _ALNUM, "")
    claims = F.filter(T.trimmed(F.split("answer", r"[。！？!?；;\.\n]+")), lambda s: F.length(bare(s)) >= 5)

    def supported(c: Column) -> Column:
        words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 1)
        named = F.exists("evidence", lambda b: F.exists(words, lambda t: F.lower(b).contains(t)))
        pool = F.array_join("evidence", "")
        return named | (pool != "") & (L.overlap(L.pairs(bare(c)), L.pairs(bare(pool))) >= 0.48)

    x = _ANSWERS.df(spark, d).withColumn("claims", claims).withColumn("ok", F.filter("claims", supported))
    n = F.size("claims")
    cover = F.when(n > 0, F.size("ok") / n).otherwise(0.0)
    return x.select("answer_id", n.cast("long").alias("claims"), F.round(cover, 3).alias("coverage"), F.when((n > 0) & (cover >= 0.6), "supported").when(F.size("evidence") == 0, "re_retrieve").otherwise("revise").alias("decision"))


#: Each document's second sentence as a point, its first three as the answer.
_POINTS = S.Derived("SELECT doc_id AS case_id, split_part(text, '.', 1) || '.' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE split_part(text, '.', 2) END || '.' || split_part(text, '.', 3) AS answer, CASE WHEN doc_id % 2 = 0 THEN lower(split_part(text, '.', 2)) ELSE split_part(split_part(text, '.', 2), ' ', 2) || ' ' || split_part(text, ' ', 9) END AS point FROM documents WHERE text IS NOT NULL")


@query(
    "answer_points",
    f"""SELECT case_id, CASE WHEN p = '' THEN false WHEN contains(a, p) THEN true ELSE g >= 0.65 OR (g >= 0.4 AND ch >= 0.72) END AS matched FROM (SELECT *, {share(_bi('p'), _bi('a'))} AS g, {share("list_distinct(regexp_split_to_array(p, ''))", "regexp_split_to_array(a, '')")} AS ch FROM (SELECT case_id, {_norm('answer')} AS a, {_norm('point')} AS p FROM {_POINTS.sql}))""",
)
def answer_points(spark, d):
    """SCL7."""
    return _POINTS.df(spark, d).select("case_id", L.point_match(F.col("answer"), F.col("point")).alias("matched"))


@query(
    "semantic_rerank",
    f"WITH {S.bm25()}, t AS ({S.top('bm25', 10)}), s AS (SELECT *, CAST('0x' || substr(md5(query_id || ':' || doc_id), 1, 4) AS INT) / 65535 AS sem FROM t) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank > 5, CASE WHEN rank <= 5 THEN -round(sem, 6) ELSE 0 END, rank) AS INT) AS place, round(score / max(abs(score)) OVER (PARTITION BY query_id), 6) AS scaled FROM s",
)
def semantic_rerank(spark, d):
    """RET28: the head of a run by an outside score (here a hash stands for the model's), the tail as it was, scores scaled by the largest."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    run = R.top_k(R.bm25(table(spark, d, "documents"), items), 10)
    sem = F.conv(F.substring(F.md5(F.concat_ws(":", "query_id", "doc_id").cast("binary")), 1, 4), 16, 10).cast("int") / 65535
    s = run.withColumn("s", F.when(F.col("rank") <= 5, -F.round(sem, 6)).otherwise(0.0))
    w = Window.partitionBy("query_id")
    return s.select("query_id", "doc_id", F.row_number().over(w.orderBy(F.col("rank") > 5, "s", "rank")).alias("place"), F.round(F.col("score") / F.max(F.abs("score")).over(w), 6).alias("scaled"))


@query(
    "rerank_fallback",
    "SELECT event_id, CASE WHEN open THEN 'circuit_open' WHEN value > 150 THEN 'timeout' WHEN event_type = 'error' THEN 'failed' ELSE 'reranked' END AS path FROM (SELECT *, coalesce(count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) >= 3 AS open FROM events)",
)
def rerank_fallback(spark, d):
    """RET29: beyond the budget, after an error, or while the last three calls failed, the order of the first stage stays."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    failed = F.count(F.when(F.col("event_type") == "error", 1)).over(w) >= 3
    path = F.when(F.col("open"), "circuit_open").when(F.col("value") > 150, "timeout").when(F.col("event_type") == "error", "failed").otherwise("reranked")
    return table(spark, d, "events").withColumn("open", failed).select("event_id", path.alias("path"))


@query(
    "rrf_first_seen",
    f"""WITH {S.bm25()}, a AS ({S.top('bm25', 10)}), b AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INT) AS rank FROM a WHERE doc_id % 2 = 0), u AS (SELECT query_id, doc_id, rank, rank AS seen FROM a UNION ALL SELECT query_id, doc_id, rank, 1000 + rank FROM b)
SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 6) DESC, min(seen)) AS INT) AS rank FROM u GROUP BY query_id, doc_id""",
)
def rrf_first_seen(spark, d):
    """RET18: ties go to the key that the lists, read one after the other, show first."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    a = R.top_k(R.bm25(table(spark, d, "documents"), items), 10).select("query_id", "doc_id", "rank")
    b = a.where("doc_id % 2 = 0").select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).alias("rank"))
    u = a.withColumn("seen", F.col("rank")).unionByName(b.withColumn("seen", 1000 + F.col("rank")))
    s = u.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.min("seen").alias("seen"))
    return s.select("query_id", "doc_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")).alias("rank"))


_KINDS = [("policy", "src0"), ("product", "src1"), ("order", "src2"), ("ticket", "src3"), ("faq", "src4"), ("case", "src5")]


@query(
    "source_retrievers",
    "WITH h AS (SELECT CASE source " + " ".join(f"WHEN '{s}' THEN '{k}'" for k, s in _KINDS) + " END AS source_kind, item_id AS query_id, doc_id, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}]{4,}')) AS q FROM benchmark) b JOIN (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[\\p{L}]{4,}')) AS t FROM documents WHERE text IS NOT NULL) x ON len(list_intersect(q, t)) > 0) "
    "SELECT source_kind, query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY source_kind, query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM h WHERE source_kind IS NOT NULL QUALIFY rank <= 3",
)
def source_retrievers(spark, d):
    """RET32, RET33 and RET36: all words of a query, each kind of source searched for them, its best three kept; an index on the words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    kind = F.lit(None).cast("string")
    for k, s in reversed(_KINDS):
        kind = F.when(F.col("source") == s, k).otherwise(kind)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words("text").alias("q")).select("query_id", F.size("q").alias("n"), F.explode("q").alias("w"))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", kind.alias("source_kind"), F.explode(words("text")).alias("w")).where("source_kind is not null")
    s = t.join(R.small(q), "w").groupBy("source_kind", "query_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("hits")).select("source_kind", "query_id", "doc_id", F.round(F.col("hits") / F.col("n"), 6).alias("score"))
    return R.top_k(s, 3, keys=("source_kind", "query_id"))


@query(
    "missing_aspect_query",
    rf"""SELECT query_id, CASE WHEN a = '' THEN trim(query) WHEN t <> '' THEN '《' || t || '》中关于“' || a || '”的要求是什么？' ELSE '关于“' || a || '”的要求是什么？' END AS built FROM (SELECT query_id, query, trim(regexp_extract(query, '{L.BOOK}', 1)) AS t, CASE WHEN query_id % 3 = 0 THEN '' ELSE trim(regexp_replace(regexp_replace('审批 时限  <' || query_id || '>', '[^\p{{L}}\p{{N}}_·《》,。，、；;：:()（）\- ]', '', 'g'), '\s+', ' ', 'g')) END AS a FROM {ASKED.sql})""",
)
def missing_aspect_query(spark, d):
    """RET39."""
    raw = F.concat(F.lit("审批 时限  <"), F.col("query_id"), F.lit(">"))
    aspect = F.when(F.col("query_id") % 3 == 0, "").otherwise(F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}_·《》,。，、；;：:()（）\- ]", ""), r"\s+", " ")))
    topic = F.trim(F.regexp_extract("query", L.BOOK, 1))
    ask = F.concat(F.lit("关于“"), aspect, F.lit("”的要求是什么？"))
    return ASKED.df(spark, d).select("query_id", F.when(aspect == "", F.trim("query")).when(topic != "", F.concat(F.lit("《"), topic, F.lit("》中"), ask)).otherwise(ask).alias("built"))


@query(
    "coverage_merge",
    """WITH r AS (SELECT query_id, doc_id, grp, place FROM (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderkey % 4 AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)), f AS (SELECT *, grp < 3 AND row_number() OVER (PARTITION BY query_id, grp ORDER BY place) = 1 AS covers FROM r)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY NOT covers, place) AS INT) AS rank FROM f QUALIFY rank <= 5""",
)
def coverage_merge(spark, d):
    """SET8: of a customer's orders in order, those that are first to cover one of three groups come first, then the others, to five."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4).alias("grp"), place.alias("place"))
    first = F.row_number().over(Window.partitionBy("query_id", "grp").orderBy("place")) == 1
    f = r.withColumn("covers", (F.col("grp") < 3) & first)
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(~F.col("covers"), "place"))).where("rank <= 5").select("query_id", "doc_id", "rank")
