from __future__ import annotations

import zlib

from lodestone.llm import language as L


def test_held_out_accuracy(spark, documents):
    model = L.fit(documents)
    rows = {r["doc_id"]: r for r in L.predict(documents, model).collect()}
    known = {r["doc_id"]: r["lang"] for r in documents.collect()}
    test = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == len(known) and all(rows[i]["held_out"] == (i in set(test)) for i in known)
    assert sum(rows[i]["lang_pred"] == known[i] for i in test) / len(test) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_odd_rows(odd_docs, documents):
    model = L.fit(documents)
    rows = {r["doc_id"]: r for r in L.predict(odd_docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] in model.languages
    assert L.predict(odd_docs.limit(0), model).count() == 0
    nothing = L.fit(odd_docs)  # every lang is null
    assert {r["lang_pred"] for r in L.predict(odd_docs, nothing).collect()} == {"und"}


def test_codewords():
    for n in (1, 2, 3, 4, 7, 12):
        code = L.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == (n if n > 1 else 1) and len(code) == n


def test_many_languages_and_long_rows(spark):
    """No language is left out for being one of many or for having long rows alone."""
    rows, n = [], 0
    for lang in range(130):
        for _ in range(6 if lang else 3):
            n += 1
            rows.append((n, f"lang{lang:03d}", " ".join(f"{chr(97 + lang % 26)}{chr(97 + lang // 26)}{k % 7}zz{chr(97 + lang % 26)}" for k in range(20 if lang else 12_000))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = L.fit(docs)
    seen = {lang for i, lang, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert model.languages == sorted(seen) and len(seen) >= 129
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, lang, _ in rows if lang in seen) / len(rows) > 0.95


def test_decoding_against_brute_force():
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((60, L.WIDTH)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = L.fit_codes(x, [f"l{k % 5}" for k in range(60)], steps=5)
    shares = model.shares(x[:4])
    for row, got in zip(x[:4], shares, strict=True):
        loss = []
        for c in range(5):
            loss.append(sum(model.trust[c, b] * math.log1p(math.exp(-float(model.code[c, b]) * (float(row @ model.weight[:, b]) + float(model.bias[b])))) for b in range(model.code.shape[1])))
        e = [math.exp(-(v - min(loss)) * model.code.shape[1]) for v in loss]
        assert np.allclose(got, np.array(e) / sum(e), atol=1e-4)
