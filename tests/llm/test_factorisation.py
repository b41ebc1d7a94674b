from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import factorisation as fm
from tests.llm.conftest import DATA


def machine(seed=1):
    rng = np.random.default_rng(seed)
    size = fm.WIDTH + len(fm.DENSE)
    return fm.Machine(0.3, rng.normal(0, 1, size), rng.normal(0, 0.3, (size, fm.RANK)), rng.normal(0, 1, len(fm.DENSE)), rng.uniform(1, 2, len(fm.DENSE)))


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def test_score_is_the_sum_over_all_pairs():
    m = machine()
    x = fm.features(*block(["a b c a", "", "one two three\nfour ## five", "ééé 日本 a"]), np.array([7.0, np.nan, 3.0, -1.0]))
    z = m.scaled(x.dense)
    for row in range(4):
        mine = slice(x.start[row], x.start[row + 1])
        idx = np.concatenate((x.word[mine], fm.WIDTH + np.arange(len(fm.DENSE))))
        val = np.concatenate((x.weight[mine], z[row]))
        want = m.bias + sum(m.linear[i] * v for i, v in zip(idx, val, strict=True))
        want += sum(m.factors[idx[a]] @ m.factors[idx[b]] * val[a] * val[b] for a in range(len(idx)) for b in range(a))
        assert abs(m.raw(x)[row] - want) < 1e-9


def test_features():
    x = fm.features(*block(["b a b", "", "x" * 70_000]), np.array([5.0, np.nan, 70_000.0]))
    assert np.diff(x.start).tolist() == [2, 0, 1]
    assert sorted(np.round(x.weight[:2] ** 2 * 3).tolist()) == [1, 2]
    stated, none, gap = x.dense[:, -3:].T
    assert none.tolist() == [0, 1, 0] and abs(gap).max() < 1e-9 and abs(stated[0] - np.log(6)) < 1e-9
    again = x.take(np.array([2, 0]))
    assert np.diff(again.start).tolist() == [1, 2] and (again.word[1:] == x.word[:2]).all()


def test_slopes_lower_the_loss():
    """On rows that only a pair of words tells apart, which no linear model can."""
    texts, y = [], []
    for k in range(400):
        a, b = k % 2, k // 2 % 2
        texts.append(f"{'left' if a else 'right'} {'up' if b else 'down'} {' '.join(f'w{(k * 7 + j) % 50}' for j in range(3))}")
        y.append(float(a == b))
    x = fm.features(*block(texts), np.array([float(len(t)) for t in texts]))
    m = fm.fit_machine(x, np.array(y), rounds=60)
    assert ((m.score(x) >= 0.5) == np.array(y)).mean() > 0.97


def test_held_out_documents_are_told_apart(spark):
    labels = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    got = fm.op12_factorisation(spark, f"{DATA}/../sf0.01").join(labels, "doc_id").where("held_out and quality is not null").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    assert len(got) > 80 and sum(right) / len(right) > 0.95
    clean = [r["predicted"] for r in got if r["quality"] == 1]
    assert sum(clean) / len(clean) > 0.98


def test_whole_table_by_plain_code(spark, documents):
    """Scores of all rows equal those of the fitted machine, pair by pair, on a row alone."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    m = fm.fit(documents, labels)
    got = {r["doc_id"]: r for r in fm.op12_factorisation(spark, DATA).collect()}
    rows = documents.select("doc_id", "text", "n_chars", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("out")).collect()
    assert len(got) == len(rows)
    for r in rows:
        x = fm.features(*block([r["text"] or ""]), np.array([float(r["n_chars"])]))
        p = 1 / (1 + np.exp(-m.raw(x)[0]))
        assert abs(got[r["doc_id"]]["score"] - p) < 1e-9
        assert got[r["doc_id"]]["predicted"] == int(p >= 0.5) and got[r["doc_id"]]["held_out"] == r["out"]


def test_learns_from_the_right_rows_only(spark, documents):
    """Held-out labels, lang, source and the ids' values change nothing."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(fm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = fm.fit(documents, labels), fm.fit(other, turned)
    assert a.bias == b.bias and (a.factors == b.factors).all()


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(6, 1), (6, 0), (9, None), (12, 1), (None, 1), (999, 0)], "doc_id long, quality int")
    for m in (machine(), fm.fit(odd_docs, labels), fm.fit(odd_docs, labels.limit(0))):
        got = fm.score(odd_docs, m).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert {r["score"] for r in got} == {0.5}
    assert fm.score(odd_docs.limit(0), machine()).collect() == []
