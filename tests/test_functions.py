from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import changes, retrieval, scope
from lodestone.sources import parsers, sinks


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"]


def test_tokens_with_chinese(spark):
    assert one(spark, T.tokens(F.col("t")), t="Hello_1 世界 foo 你好") == ["hello_1", "世", "界", "foo", "你", "好", "世界", "界你", "你好"]
    assert one(spark, T.approx_tokens(F.col("t")), t="世界ab") == 4


@pytest.mark.parametrize(("text", "want"), [("abc", ["ab", "bc"]), ("a", []), ("", []), ("日本語", ["日本", "本語"])])
def test_char_grams(spark, text, want):
    assert one(spark, T.char_grams(F.col("t")), t=text) == want


def test_keys(spark):
    assert one(spark, T.parse_stable_key(F.col("t")), t="A:b.md:2:7") == ("A", "b.md", 2, 7)
    assert one(spark, T.parse_stable_key(F.col("t")), t="A:b:x:7") == ("A", "b", None, 7)
    assert one(spark, T.parse_stable_key(F.col("t")), t="A:b") == (None, None, None, None)


def test_sentences_and_normal_form(spark):
    assert one(spark, T.sentences(F.col("t")), t="One! Two? 三。四") == ["One!", "Two?", "三。", "四"]
    assert one(spark, T.normalise(F.col("t")), t="  a \t b  \n\n\n\nc ") == "a b\n\nc"
    assert one(spark, T.clip(F.col("t"), 8), t="abcdef  ghijk") == "abcde..."


def test_scores(spark):
    q, t = F.col("q"), F.col("t")
    assert one(spark, T.keyword_score(q, t), q="red fox, xx", t="the RED wolf") == pytest.approx(1 / 3)
    assert one(spark, T.phrase_score(q, t), q="red  fox", t="a Red fox") == 1.0
    assert one(spark, T.gram_recall(q, t), q="abc", t="xxabyy") == 0.5


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), t="x") == 0.0
    assert one(spark, V.parse_embedding(F.col("t")), t="[1, 2.5, -3e1]") == [1.0, 2.5, -30.0] and one(spark, V.parse_embedding(F.col("t")), t="[1, \"a\"]") is None


def test_diff_order(spark):
    old = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c")], "logical_key string, chunk_hash string")
    new = spark.createDataFrame([("k1", "a"), ("k2", "x"), ("k9", "c"), ("k8", "z")], "logical_key string, chunk_hash string")
    assert sorted(map(tuple, changes.diff_chunks(old, new).collect())) == [("k1", "unchanged"), ("k2", "deleted"), ("k2", "modified"), ("k8", "added"), ("k9", "moved")]


def test_minmax_and_scope(spark):
    run = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 0.0), (2, 1, 5.0)], "query_id int, doc_id int, score double")
    assert sorted(r["score"] for r in retrieval.minmax_positive(run).collect()) == [0.0, 0.0, 1.0, 1.0]
    rows = spark.createDataFrame([(1, 10), (1, None), (2, 10)], "organization_id int, classification_level int")
    assert scope.scoped(rows, 1, 7, 20).count() == 1 and scope.scoped(rows, 1, 7, 20, fail_closed=False).count() == 2


def test_markdown(spark):
    text = "# A\nintro\n## B\n- item\n```\n# not\n```\n| x | y |\n|---|---|\n| 1 | 2 |\n# C\n> q"
    rows = parsers.markdown_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("line_no").collect()
    assert [(r["kind"], r["section_path"]) for r in rows] == [
        ("heading", "A"), ("paragraph", "A"), ("heading", "A > B"), ("list", "A > B"), ("code", "A > B"), ("code", "A > B"), ("code", "A > B"), ("table", "A > B"), ("table", "A > B"), ("heading", "C"), ("quote", "C"),
    ]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "r")
    assert sinks.append_missing(rows.limit(1), path, ["k"]) == 1 and sinks.append_missing(rows, path, ["k"]) == 1 and sinks.append_missing(rows, path, ["k"]) == 0
    for g in ("G1", "G2", "G2"):
        sinks.write_generation(rows, str(tmp_path / "g"), g)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    assert parsers.read_jsonl(spark, str(tmp_path / "j"), "k int, v string, w string", ["k", "w"]).first()["errors"] == ["w"]


def test_six_decimals_are_rounded_from_the_exact_value(spark):
    """0.0078125 and 0.0234375 lie halfway and go to the even digit; 3.4e38 has more digits than its shortest form."""
    v = [0.0078125, 0.0234375, -0.0078125, 3.4e38, float("nan"), float("-inf"), None, 1.0]
    want = ",".join(["0.007812", "0.023438", "-0.007812", f"{3.4e38:.6f}", "nan", "-inf", "1.000000"])
    rows = spark.createDataFrame([(0, v), (1, []), (2, None)], "id int, v array<double>").select("id", V.six_decimals(F.col("v")).alias("x")).collect()
    assert {r["id"]: r["x"] for r in rows} == {0: want, 1: "", 2: None}
