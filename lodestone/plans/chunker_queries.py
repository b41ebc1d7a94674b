"""Queries of chunkers by kind of document: over all documents where they apply, and over a few documents of each kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunkers as K
from lodestone.plans import registry as S
from lodestone.plans.registry import query, table

#: Documents of each kind as blocks.
DOCS = S.Fixture(
    "doc_id int, blocks array<string>",
    [
        (1, ["常见问题", "Q: How?", "A: So.", "and more", "Q: Why?", "问：长？", "答：" + "甲" * 200 + "。" + "乙" * 200 + "。"]), (2, ["A: orphan", "ignored", "Q：only"]),
        (3, ["总则办法", "第一条 目的", "（一）甲", "（二）乙", "第二条 长项", "丙" * 200, "丁" * 200, "戊" * 300 + "。" + "己" * 300 + "。", "第三条"]), (4, ["step plan", "注意：备份", "步骤1 " + "一" * 100, "步骤2 " + "二" * 200, "警告：小心", "Step 3 " + "x" * 400, "第4步 " + "y" * 100]),
        (5, ["前置条件：无", "长行" + "子" * 300 + "\n" + "丑" * 200 + "\n" + "寅" * 10, "1. a", "2. b", "3. c"]), (6, ["| h1 | h2 |", "|a|b|\n|" + "c" * 600 + "|d|\n|" + "e" * 600 + "|f|\n|g|h|"]), (7, ["plain story"]), (8, []), (9, ["", "  "]),
    ],
)


def tok(x: str) -> str:
    other = f"length(regexp_replace({x}, '[{S.CJK}]', '', 'g'))"
    return f"CAST(floor((length({x}) - {other}) * 1.3 + {other} / 4 + 0.999) AS BIGINT)"


def greedy(u: str, name: str, limit: int, alone: int = 1 << 30) -> str:
    """A recursive CTE over u (id, i from 1, t): the group of each unit."""
    new = f"({u}.t > {alone} OR {name}.solo OR {name}.held + {u}.t > {limit})"
    return f"{name} AS (SELECT id, i, 0 AS grp, t AS held, t > {alone} AS solo FROM {u} WHERE i = 1 UNION ALL SELECT {u}.id, {u}.i, grp + CASE WHEN {new} THEN 1 ELSE 0 END, CASE WHEN {new} THEN {u}.t ELSE {name}.held + {u}.t END, {u}.t > {alone} FROM {name} JOIN {u} ON {u}.id = {name}.id AND {u}.i = {name}.i + 1)"


def _sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


def _listed(source: str, key: str, items: str) -> str:
    """(id, i, x, t) of the items of a list."""
    return f"SELECT id, i, x, {tok('x')} AS t FROM (SELECT {key} AS id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT *, {items} AS l FROM {source}))"


_PARAGRAPHS = r"list_filter(string_split(regexp_replace(regexp_replace(text, '^#+\s*', ''), '\n\s*\n', chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(
    "narrative_chunks",
    rf"""WITH RECURSIVE p AS ({_listed('documents', 'doc_id', _PARAGRAPHS)}),
{greedy('p', 'g', 450, 700)}, gs AS (SELECT g.id, g.grp, bool_or(g.solo) AS solo, string_agg(p.x, chr(10) || chr(10) ORDER BY p.i) AS body FROM g JOIN p ON p.id = g.id AND p.i = g.i GROUP BY ALL),
s AS ({_listed('(SELECT * FROM gs WHERE solo)', "id || ':' || grp", _sentences('body'))}), {greedy('s', 'sg', 700, 700)},
sp AS (SELECT sg.id, sg.grp, string_agg(s.x, '' ORDER BY s.i) AS body FROM sg JOIN s ON s.id = sg.id AND s.i = sg.i GROUP BY ALL),
parts AS (SELECT id, list_transform(flatten(list(CASE WHEN {tok('body')} > 700 THEN list_transform(range(0, CAST(ceil(length(body) / 2797) AS BIGINT)), lambda k: substr(body, k * 2797 + 1, 2797)) ELSE [body] END ORDER BY grp)), lambda x: x) AS l FROM sp GROUP BY ALL),
u AS (SELECT gs.id, gs.grp, gs.solo, CASE WHEN solo THEN parts.l ELSE [body] END AS l FROM gs LEFT JOIN parts ON parts.id = gs.id || ':' || gs.grp),
r AS (SELECT id, grp, l AS out FROM u WHERE grp = 0 UNION ALL SELECT u.id, u.grp, CASE WHEN u.solo THEN u.l WHEN regexp_replace(right(r.out[-1], 240), '^\s+', '') = '' THEN u.l ELSE [regexp_replace(right(r.out[-1], 240), '^\s+', '') || chr(10) || chr(10) || u.l[1]] END FROM r JOIN u ON u.id = r.id AND u.grp = r.grp + 1)
SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY grp, k) - 1 AS INT) AS ordinal, length(c) AS n, md5(c) AS content_md5 FROM (SELECT id, grp, unnest(range(0, len(out))) AS k, unnest(out) AS c FROM r)""",
)
def narrative_chunks(spark, d):
    """DOC8 and WIN7 over all documents."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.array("text").alias("blocks"))
    return K.narrative(docs).select("doc_id", "ordinal", F.length("content").cast("long").alias("n"), F.md5("content").alias("content_md5"))


@query(
    "fallback_chunks",
    rf"""WITH RECURSIVE s AS ({_listed('documents', 'doc_id', _sentences("text"))}), a AS (SELECT id, list(t ORDER BY i) AS ts, list(x ORDER BY i) AS xs FROM s GROUP BY ALL),
w AS (SELECT id, 1 AS k, 0 AS lo, ts[1] AS held, CAST(NULL AS BIGINT) AS a0, CAST(NULL AS BIGINT) AS a1 FROM a UNION ALL SELECT id, k + 1, CASE WHEN cutn THEN k - m ELSE lo END, CASE WHEN cutn THEN list_sum(ts[k - m + 1:k]) ELSE held END + ts[k + 1], CASE WHEN cutn THEN lo END, CASE WHEN cutn THEN k END
FROM (SELECT w.*, a.ts, w.held + a.ts[w.k + 1] > 420 AS cutn, coalesce(list_max(list_filter(range(2, w.k - w.lo + 1), lambda q: list_sum(a.ts[w.k - q + 1:w.k]) <= 50)), 1) AS m FROM w JOIN a USING (id) WHERE w.k < len(a.ts)))
SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY a1) - 1 AS INT) AS part, md5(array_to_string(xs[a0 + 1:a1], '')) AS content_md5 FROM (SELECT id, a0, a1 FROM w WHERE a1 IS NOT NULL UNION ALL SELECT id, lo, k FROM (SELECT w.*, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS z FROM w) WHERE z = 1) JOIN a USING (id)""",
)
def fallback_chunks(spark, d):
    """DOC13 over all documents."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.array("text").alias("blocks"))
    return K.fallback(docs).select("doc_id", "part", F.md5("content").alias("content_md5"))


_COUNT = "len(regexp_extract_all(j, '{}'))"


def _profile(source: str) -> str:
    q, a, c = _COUNT.format(K.FAQ_Q), _COUNT.format(K.FAQ_A), _COUNT.format(K.ANY_CLAUSE)
    return (
        f"SELECT doc_id, CASE WHEN share >= 0.3 THEN 'table_records' WHEN {q} >= 1 AND {a} >= 1 AND (contains(j, 'FAQ') OR contains(j, '常见问题') OR {q} >= 2) THEN 'faq' WHEN {c} >= 3 AND regexp_matches(j, '{K.POLICY_WORDS}') THEN 'policy' "
        f"WHEN st >= 3 AND (regexp_matches(j, '{K.CONDITION_WORDS}') OR regexp_matches(j, '{K.WARNING_WORDS}')) THEN 'procedure' WHEN {c} >= 2 THEN 'policy' WHEN st >= 3 THEN 'procedure' ELSE 'narrative' END AS profile FROM (SELECT *, len(list_filter(string_split(j, chr(10)), lambda l: regexp_matches(l, '{K.STEP_LINE}'))) AS st FROM "
        f"(SELECT doc_id, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)) AS j, len(list_filter(blocks, lambda b: starts_with(b, '|'))) / greatest(1, len(list_filter(blocks, lambda b: b <> ''))) AS share FROM {source}))"
    )


_ALL = f"(SELECT doc_id, blocks FROM {DOCS.sql} UNION ALL SELECT 1000 + doc_id, string_split(text, chr(10)) FROM documents WHERE text IS NOT NULL)"


@query("document_profile", _profile(_ALL))
def document_profile(spark, d):
    """DOC7."""
    own = table(spark, d, "documents").where("text is not null").select((1000 + F.col("doc_id")).alias("doc_id"), F.split("text", "\n").alias("blocks"))
    return DOCS.df(spark).select(F.col("doc_id").cast("long"), "blocks").unionByName(own).select("doc_id", K.profile(F.col("blocks")).alias("profile"))


# Sentences of a document, in order, with blanks as one and without other marks; each kind of document makes its blocks of them.
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '[!?;。！？；|]', '', 'g'), '.'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"
_EACH = f"(SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL))"


def sentence_blocks(spark, d, block):
    """documents as (doc_id, blocks): block makes one of a sentence and its number."""
    s = F.filter(F.transform(F.split(F.regexp_replace("text", "[!?;。！？；|]", ""), r"\."), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.transform(s, block).alias("blocks"))


def _in_order(at: list[str], text, sep: str):
    """The texts of a key's parts in order as one."""
    rows = F.array_sort(F.collect_list(F.struct(*at, text.alias("_t"))))
    return F.array_join(F.transform(rows, lambda x: x["_t"]), sep)


@query(
    "faq_chunks",
    f"SELECT doc_id, CAST(i // 2 AS INT) AS pair, CASE WHEN count(*) = 2 THEN 'ok' ELSE 'low_quality' END AS quality, md5('Q: ' || max(CASE WHEN i % 2 = 0 THEN s END) || chr(10) || coalesce(max(CASE WHEN i % 2 = 1 THEN s END), '')) AS text_md5 FROM {_EACH} GROUP BY doc_id, i // 2",
)
def faq_chunks(spark, d):
    """DOC9 over all documents, their sentences as questions and answers in turn: what each pair's parts say together."""
    blocks = sentence_blocks(spark, d, lambda s, i: F.concat(F.when(i % 2 == 0, "Q: ").otherwise("A: "), s))
    parts = K.faq(blocks).withColumn("t", F.regexp_replace("embedding_text", "\nA: ", "\n"))
    return parts.groupBy("doc_id", "pair", "quality").agg(F.md5(_in_order(["part"], F.col("t"), "")).alias("text_md5"))


@query(
    "policy_chunks",
    f"SELECT doc_id, CAST(i // 4 AS INT) AS clause, '第' || (i - i % 4) || '条 ' || max(CASE WHEN i % 4 = 0 THEN s END) AS heading, md5(coalesce(string_agg(CASE WHEN i % 4 > 0 THEN s END, chr(10) ORDER BY i), '')) AS items_md5 FROM {_EACH} GROUP BY doc_id, i // 4, i - i % 4",
)
def policy_chunks(spark, d):
    """DOC10 over all documents, every fourth sentence the heading of a clause: the items of each clause as its parts hold them, under a heading that all repeat."""
    blocks = sentence_blocks(spark, d, lambda s, i: F.when(i % 4 == 0, F.concat(F.lit("第"), i, F.lit("条 "), s)).otherwise(s))
    parts = K.policy(blocks).where(F.col("content").startswith(F.col("heading")))
    items = F.substring("content", F.length("heading") + 2, F.length("content"))
    return parts.groupBy("doc_id", "clause", "heading").agg(F.md5(_in_order(["part", "sub"], items, "\n")).alias("items_md5"))


_STEPS = "CASE WHEN i % 3 = 0 THEN 'Step ' || i || ' ' || s WHEN i % 6 = 2 THEN 'Warning: ' || s ELSE s END"


@query("procedure_chunks", f"SELECT doc_id, count(*) FILTER (i % 6 = 2) > 0 AS warned, md5(string_agg({_STEPS}, chr(10) ORDER BY i)) AS text_md5 FROM {_EACH} GROUP BY ALL")
def procedure_chunks(spark, d):
    """DOC11 over all documents, their sentences as steps with warnings: nothing is lost or moved, and no part that begins a group ends with a warning."""
    blocks = sentence_blocks(spark, d, lambda s, i: F.when(i % 3 == 0, F.concat(F.lit("Step "), i, F.lit(" "), s)).when(i % 6 == 2, F.concat(F.lit("Warning: "), s)).otherwise(s))
    parts = K.procedure(blocks)
    return parts.groupBy("doc_id").agg(F.bool_or("has_warning").alias("warned"), F.md5(_in_order(["part", "sub", "line"], F.col("content"), "\n")).alias("text_md5"))


@query("table_chunks", f"SELECT doc_id, count(*) AS rows, md5(string_agg(s || ' - ' || i, chr(10) ORDER BY i)) AS rows_md5 FROM {_EACH} GROUP BY ALL")
def table_chunks(spark, d):
    """DOC12 over all documents, their sentences as the rows of a table: the rows of all parts, each part under the header."""
    lines = sentence_blocks(spark, d, lambda s, i: F.concat(F.lit("| "), s, F.lit(" | "), i, F.lit(" |"))).where(F.size("blocks") > 0)
    parts = K.tables(lines.select("doc_id", F.array(F.concat(F.lit("| text | no |\n"), F.array_join("blocks", "\n"))).alias("blocks"))).where(F.col("content").startswith("表头: text | no\n"))
    body = F.regexp_replace("content", "^表头: text \\| no\n", "")
    return parts.groupBy("doc_id").agg(F.sum(F.col("row_end") - F.col("row_start") + 1).alias("rows"), F.md5(_in_order(["table_no", "part"], body, "\n")).alias("rows_md5"))


#: Documents with the marks of each kind put before them.
_MARKED = S.Derived(
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Q: a' || chr(10) || 'A: b' || chr(10) || 'Q: c' || chr(10) || 'A: d' || chr(10) WHEN 1 THEN '办法' || chr(10) || '第1条 a' || chr(10) || '第2条 b' || chr(10) || '第3条 c' || chr(10) WHEN 2 THEN 'Caution' || chr(10) || 'Step 1 a' || chr(10) || 'Step 2 b' || chr(10) || 'Step 3 c' || chr(10) WHEN 3 THEN '|a|b|' || chr(10) || '|1|2|' || chr(10) || '|3|4|' || chr(10) WHEN 4 THEN '第1条 a' || chr(10) || '第2条 b' || chr(10) ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL"
)


@query(
    "chunk_strategy",
    f"SELECT doc_id, profile || ':v2:target=' || CASE profile WHEN 'narrative' THEN '450:max=700:overlap=60' WHEN 'faq' THEN '220:max=400:overlap=0' WHEN 'policy' THEN '300:max=550:overlap=0' WHEN 'procedure' THEN '340:max=450:overlap=0' ELSE '300:max=450:overlap=0' END AS fingerprint FROM ({_profile('(SELECT doc_id, string_split(text, chr(10)) AS blocks FROM ' + _MARKED.sql + ')')})",
)
def chunk_strategy(spark, d):
    """DOC14: which chunker a document goes to, and the fingerprint of its settings."""
    sizes = {("table_records" if k == "table" else k): v for k, v in K.SIZES.items() if k != "fallback"}
    of = F.create_map(*(F.lit(x) for k, (t, m, o) in sizes.items() for x in (k, f"{k}:v2:target={t}:max={m}:overlap={o}")))
    return _MARKED.df(spark, d).select("doc_id", of[K.profile(F.split("text", "\n"))].alias("fingerprint"))


@query(
    "embedding_inputs",
    "SELECT doc_id, md5(substr('[文档] ' || coalesce(source, '') || chr(10) || '[章节] ' || lang || ' > part' || chr(10) || '[类型] narrative' || chr(10) || text, 1, 600)) AS input_md5 FROM documents WHERE text IS NOT NULL",
)
def embedding_inputs(spark, d):
    """DOC16: title, path of headings and kind before the text, cut at a cap."""
    parts = F.concat_ws("\n", F.concat(F.lit("[文档] "), F.coalesce("source", F.lit(""))), F.concat(F.lit("[章节] "), F.array_join(F.array("lang", F.lit("part")), " > ")), F.lit("[类型] narrative"), F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.substring(parts, 1, 600)).alias("input_md5"))


_KEY = "'doc-' || doc_id || ':' || CASE WHEN trim(a) = '' THEN '_root' ELSE substr(replace(trim(a), ':', '_'), 1, 64) END || ':text:' || (doc_id % 9)"


@query("logical_keys", f"SELECT doc_id, {_KEY} AS logical_key FROM (SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || ':' || lang END, '') AS a FROM documents)")
def logical_keys(spark, d):
    """DOC15 and SCL3: a key that stays when text before it changes."""
    a = F.coalesce(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat("source", F.lit(":"), "lang")), F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.logical_key(F.col("doc_id"), a, F.lit("text"), F.col("doc_id") % 9).alias("logical_key"))


@query(
    "document_pipeline",
    f"""SELECT profile, count(*) AS documents, count_if(n = 0) AS empty FROM (SELECT p.profile, length(d.text) AS n FROM ({_profile("(SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS blocks FROM documents)")}) p JOIN documents d USING (doc_id)) GROUP BY ALL""",
)
def document_pipeline(spark, d):
    """DOC18: parse, check and profile in one pass over the documents."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), K.profile(F.split(F.coalesce("text", F.lit("")), "\n")).alias("profile"))
    return docs.groupBy("profile").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") == 0).alias("empty"))
