"""Chunkers over a few documents whose chunks were worked out by hand, and what the number of a text must not do to it."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import fields as L
from lodestone.functions import text as T
from lodestone.operators import chunkers as K
from lodestone.plans import registry as S
from lodestone.sources import parsers

_NL = "chr(10)"
DOCS = S.Fixture(
    "doc_id int, blocks array<string>",
    [
        (1, ["常见问题", "Q: How?", "A: So.", "and more", "Q: Why?", "问：长？", "答：" + "甲" * 200 + "。" + "乙" * 200 + "。"]), (2, ["A: orphan", "ignored", "Q：only"]),
        (3, ["总则办法", "第一条 目的", "（一）甲", "（二）乙", "第二条 长项", "丙" * 200, "丁" * 200, "戊" * 300 + "。" + "己" * 300 + "。", "第三条"]), (4, ["step plan", "注意：备份", "步骤1 " + "一" * 100, "步骤2 " + "二" * 200, "警告：小心", "Step 3 " + "x" * 400, "第4步 " + "y" * 100]),
        (5, ["前置条件：无", "长行" + "子" * 300 + "\n" + "丑" * 200 + "\n" + "寅" * 10, "1. a", "2. b", "3. c"]), (6, ["| h1 | h2 |", "|a|b|\n|" + "c" * 600 + "|d|\n|" + "e" * 600 + "|f|\n|g|h|"]), (7, ["plain story"]), (8, []), (9, ["", "  "]),
    ],
)

WANT = {
    "faq": f"""SELECT doc_id, pair, part, quality, md5(content) AS content_md5, md5(embedding) AS embedding_md5 FROM (VALUES (1, 0, 0, 'ok', 'Q: How?' || {_NL} || 'A: So.' || {_NL} || 'and more', 'Q: How?' || {_NL} || 'A: So.' || {_NL} || 'and more'), (1, 1, 0, 'low_quality', 'Q: Why?' || {_NL} || 'A: ', 'Q: Why?' || {_NL} || 'A: '),
(1, 2, 0, 'ok', repeat('甲', 200) || '。', 'Q: 长？' || {_NL} || repeat('甲', 200) || '。'), (1, 2, 1, 'ok', repeat('乙', 200) || '。', 'Q: 长？' || {_NL} || repeat('乙', 200) || '。'), (2, 0, 0, 'low_quality', 'orphan', 'orphan'), (2, 1, 0, 'low_quality', 'Q: only' || {_NL} || 'A: ', 'Q: only' || {_NL} || 'A: ')) v(doc_id, pair, part, quality, content, embedding)""",
    "policy": f"""SELECT doc_id, clause, part, sub, md5(content) AS content_md5 FROM (VALUES (3, 0, 0, 0, '(未编号)' || {_NL} || '总则办法'), (3, 1, 0, 0, '第一条 目的' || {_NL} || '（一）甲' || {_NL} || '（二）乙'), (3, 2, 0, 0, '第二条 长项' || {_NL} || repeat('丙', 200)), (3, 2, 1, 0, '第二条 长项' || {_NL} || repeat('丁', 200)),
(3, 2, 2, 0, '第二条 长项' || {_NL} || repeat('戊', 300) || '。'), (3, 2, 2, 1, '第二条 长项' || {_NL} || repeat('己', 300) || '。'), (3, 3, 0, 0, '第三条')) v(doc_id, clause, part, sub, content)""",
    "procedure": f"""SELECT doc_id, part, sub, line, has_warning, md5(content) AS content_md5 FROM (VALUES (4, 0, 0, 0, true, 'step plan' || {_NL} || '注意：备份' || {_NL} || '步骤1 ' || repeat('一', 100)), (4, 1, 0, 0, true, '步骤2 ' || repeat('二', 200) || {_NL} || '警告：小心'), (4, 2, 0, 0, false, 'Step 3 ' || repeat('x', 400) || {_NL} || '第4步 ' || repeat('y', 100)),
(5, 0, 0, 0, false, '前置条件：无'), (5, 0, 1, 0, false, '长行' || repeat('子', 300) || {_NL}), (5, 0, 1, 1, false, repeat('丑', 200) || {_NL} || repeat('寅', 10)), (5, 0, 2, 0, false, '1. a' || {_NL} || '2. b' || {_NL} || '3. c')) v(doc_id, part, sub, line, has_warning, content)""",
    "table": f"""SELECT doc_id, table_no, part, row_start, row_end, md5(content) AS content_md5 FROM (VALUES (6, 0, 0, CAST(NULL AS INT), CAST(NULL AS INT), '| h1 | h2 |'), (6, 1, 0, 0, 0, '表头: a | b' || {_NL} || repeat('c', 600) || ' - d'), (6, 1, 1, 1, 2, '表头: a | b' || {_NL} || repeat('e', 600) || ' - f' || {_NL} || 'g - h')) v(doc_id, table_no, part, row_start, row_end, content)""",
}


def chunks(name, spark):
    docs = DOCS.df(spark)
    if name == "faq":
        return K.faq(docs.where("doc_id <= 2")).select("doc_id", "pair", "part", "quality", F.md5("content").alias("content_md5"), F.md5("embedding_text").alias("embedding_md5"))
    if name == "policy":
        return K.policy(docs.where("doc_id = 3")).select("doc_id", "clause", "part", "sub", F.md5("content").alias("content_md5"))
    if name == "procedure":
        return K.procedure(docs.where("doc_id in (4, 5)")).select("doc_id", "part", "sub", "line", "has_warning", F.md5("content").alias("content_md5"))
    return K.tables(docs).select("doc_id", "table_no", "part", "row_start", "row_end", F.md5("content").alias("content_md5"))


@pytest.mark.parametrize("name", sorted(WANT))
def test_chunks_worked_out_by_hand(spark, name):
    df = chunks(name, spark)
    columns = sorted(df.columns)
    out = duckdb.sql(WANT[name])
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[out.columns.index(c)]) for c in columns) for r in out.fetchall())


def test_a_text_keeps_its_characters_whatever_its_number(spark):
    """Digits at a text's ends stay, blanks go: the place in the array is no list of characters to trim."""
    texts = [f" {k}x{k} " for k in range(12)]
    df = spark.createDataFrame([(1, texts, "\n\n".join(texts))], "doc_id int, blocks array<string>, text string")
    row = df.select(T.trimmed(F.col("blocks")).alias("t")).first()["t"]
    assert row == [t.strip() for t in texts]
    assert [r["content"] for r in parsers.plain_blocks(df.select("doc_id", "text")).orderBy("block_index").collect()] == row
    faq = df.select("doc_id", F.array(*(F.lit(x) for k in range(12) for x in (f"Q: {k} is {k}", f"A: {k} too {k}"))).alias("blocks"))
    assert [r["content"] for r in K.faq(faq).orderBy("pair").collect()] == [f"Q: {k} is {k}\nA: {k} too {k}" for k in range(12)]
    clause = df.select("doc_id", F.array(*(F.lit(f"第{k}条 {k}") for k in range(1, 12))).alias("blocks"))
    assert [r["content"] for r in K.policy(clause).orderBy("clause").collect()] == [f"第{k}条 {k}" for k in range(1, 12)]
    table = df.select("doc_id", F.array(F.lit("| h | 1 |\n| 0 | 1 |\n| 10 | 11 |")).alias("blocks"))
    assert K.tables(table).first()["content"] == "表头: h | 1\n0 - 1\n10 - 11"
    parsed = spark.createDataFrame([("# t\n## 0 s 0\nx\n## 1 s 1\ny",)], "c string").select(L.parse(F.col("c")).alias("f")).first()["f"]
    assert parsed["sections"] == ["0 s 0", "1 s 1"]


def test_nothing_is_lost_where_a_part_is_missing(spark):
    """A long question without an answer, and a long heading without items, are chunks of their own."""
    long = "word " * 700
    faq = K.faq(spark.createDataFrame([(1, [f"Q: {long}"])], "doc_id int, blocks array<string>")).collect()
    assert len(faq) == 1 and long.strip() in faq[0]["content"]
    policy = K.policy(spark.createDataFrame([(1, [f"第1条 {long}", "第2条 b"])], "doc_id int, blocks array<string>")).collect()
    assert len(policy) == 2
