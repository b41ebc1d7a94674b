"""Operators beyond their registered queries: against plain code, on odd rows and on empty tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import statistics as X
from lodestone.functions import text as T
from lodestone.operators import chunkers as K
from lodestone.operators import retrieval as R
from lodestone.sources import parsers, sinks


def tokens(text: str) -> int:
    cjk = sum("一" <= c <= "鿿" for c in text)
    return math.floor(cjk * 1.3 + (len(text) - cjk) / 4 + 0.999)


def test_greedy_groups(spark):
    rng = random.Random(4)
    rows = [(i, ["x" * rng.randrange(1, 90) for _ in range(rng.randrange(0, 12))]) for i in range(60)]
    got = {r["i"]: r["g"] for r in spark.createDataFrame(rows, "i int, u array<string>").select("i", K.greedy(F.col("u"), 25, first=2, later=3, alone=20).alias("g")).collect()}
    for i, units in rows:
        want, group, held, last_alone = [], 0, 2, False
        for k, u in enumerate(units):
            t = tokens(u)
            if k and (t > 20 or last_alone or held + t > 25):
                group, held = group + 1, 3
            held += t
            last_alone = t > 20
            want.append(group)
        assert list(got[i]) == want


def test_cuts_and_tails(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("甲乙丙abc ") for _ in range(rng.randrange(0, 400))) for _ in range(25)]
    df = K.cut(spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "i int, u array<string>"), "u", 30, "parts")
    for r in df.collect():
        parts, text = r["parts"], texts[r["i"]]
        assert "".join(parts) == text
        # each part but the last just reaches the bound
        assert all(tokens(p) >= 30 and tokens(p[:-1]) < 30 for p in parts[:-1])
    tails = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(K.tail(F.col("x"), 10).alias("t")).collect()]
    for text, got in zip(texts, tails, strict=True):
        held, n = 0.0, 0
        for c in reversed(text):
            n += 1
            held += 1 if ord(c) > 0x2E80 else 0.25
            if held >= 10:
                break
        assert got == (text[-n:] if n else "").lstrip()


def test_narrative_chunks_of_chinese_text(spark):
    paragraphs = ["甲" * 200, "乙" * 200, "丙" * 700, "丁。" * 300]
    docs = spark.createDataFrame([(1, ["# 一", *paragraphs[:2], "# 二", *paragraphs[2:]]), (2, []), (3, ["", " "])], "doc_id int, blocks array<string>")
    rows = sorted(K.narrative(docs).collect(), key=lambda r: (r["s"], r["ordinal"]))
    assert {r["doc_id"] for r in rows} == {1} and [r["section"] for r in rows][:2] == ["一", "一"]
    first = rows[0]["content"]
    assert first == "一\n\n" + "甲" * 200 and rows[1]["content"] == first[-60:] + "\n\n" + "乙" * 200
    second = [r["content"] for r in rows if r["section"] == "二"]
    # the long paragraph is cut, and the packed one after it begins with its end
    assert second[0] == "二" and [c.count("丙") for c in second[1:]] == [538, 162, 60] and second[-1].endswith("丁。" * 300)
    assert K.narrative(docs.limit(0)).count() == 0 and K.faq(docs.limit(0)).count() == 0 and K.fallback(docs.limit(0)).count() == 0


def test_percentiles_are_numpy_s(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 3, float(v) if v < 0.9 else None) for k, v in enumerate(rng.random(200).round(2))]
    got = X.percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()
    for r in got:
        own = [v for k, v in rows if k == r["k"] and v is not None]
        assert np.allclose([r["a"], r["m"], r["z"]], np.quantile(own, [0.1, 0.5, 0.99]))
    z = spark.createDataFrame([(x / 10,) for x in range(0, 40, 3)], "z double").select("z", X.normal_sf(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(r["z"] / math.sqrt(2))) < 2e-7 for r in z)


def test_substring_search(spark):
    rng = random.Random(8)
    words = "aa bb cc dd ee ff".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(80)] + [(99, None), (100, "")]
    asked = [(1, "bb"), (2, "a bb c"), (3, "aa bb cc"), (4, docs[5][1]), (5, "cc dd ee"), (6, None)]
    got = {tuple(r) for r in R.containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "query_id int, query string")).collect()}
    assert got == {(q, i) for q, s in asked if s is not None for i, t in docs if t is not None and s in t}


def test_nearest_vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(120, 8))
    v[7] = 0
    index = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [1.0])], "vec_id long, embedding array<double>").repartition(3)
    q = index.where("vec_id % 10 = 0 and vec_id < 120").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in R.knn(index, q, 5).collect()}
    for i in range(0, 120, 10):
        size = np.linalg.norm(v, axis=1) * np.linalg.norm(v[i])
        cos = np.divide(v @ v[i], size, out=np.zeros(120), where=size > 0)
        score = np.round(1 / (1 + np.maximum(0, 1 - cos)), 6)
        order = [j for j in sorted(range(120), key=lambda j: (-score[j], j)) if j != i][:5]
        assert [got[i, r][0] for r in range(1, 6)] == order
    assert R.knn(index, q.limit(0), 5).count() == 0


def test_bm25_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta"), (4, "alpha alpha"), (None, "alpha")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, None), (3, "")], "query_id int, query string")
    got = R.bm25(docs, q).collect()
    assert {r["query_id"] for r in got} == {1} and {r["doc_id"] for r in got} == {3, 4, None}
    assert R.bm25(docs.limit(0), q).count() == 0 and R.bm25(docs, q.limit(0)).count() == 0


def test_reports_and_optional_libraries(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    assert sinks.markdown_report(df, "T") == "# T\n\n| k | n |\n| --- | --- |\n| a | 1 |"
    import importlib.util

    if importlib.util.find_spec("openpyxl") is None:
        with pytest.raises(RuntimeError):
            sinks.write_xlsx(df, str(tmp_path / "x.xlsx"))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 broken")
    files = spark.read.format("binaryFile").load(str(tmp_path / "broken.pdf"))
    row = parsers.pdf_texts(files).first()
    assert row["text"] is None and row["error"]


def test_mime(spark):
    rows = [(bytearray(b"MZ9"), "a.bin"), (bytearray(b"\x7fELF"), "b"), (bytearray(b"<?xml v"), "c"), (bytearray(b"%PDF-1"), "d.txt"), (bytearray(b"# t"), "e.md"), (bytearray(b""), "f")]
    got = [r["m"] for r in spark.createDataFrame(rows, "content binary, name string").select(parsers.mime(F.col("content"), F.col("name")).alias("m")).collect()]
    assert got == ["application/x-msdownload", "application/x-executable", "application/xml", "application/pdf", "text/markdown", "text/plain"]


def test_clip_and_keys(spark):
    r = spark.createDataFrame([("a  b" * 40, "  x:y ")], "t string, a string").select(T.clip(F.col("t"), 20).alias("c"), T.logical_key(F.lit(7), F.col("a"), F.lit("text"), F.lit(2)).alias("k"), T.logical_key(F.lit(7), F.lit(" "), F.lit("text"), F.lit(0)).alias("r")).first()
    assert len(r["c"]) == 20 and r["c"].endswith("...") and r["k"] == "doc-7:x_y:text:2" and r["r"] == "doc-7:_root:text:0"
