from __future__ import annotations

import re
from collections import Counter

import numpy as np

from lodestone.llm import quality as Q
from tests.llm.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def same(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[n] for n in Q.BASE) == want, r
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


def test_whole_table(spark, documents, texts):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = Q.judge(documents, labels).collect()
    assert len(rows) == len(texts)
    same(rows, texts)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [r for r in rows if r["doc_id"] in truth and not r["base_failed"]]
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in judged) / len(judged) > 0.85
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {r["doc_id"] for r in Q.keep(documents, labels).select("doc_id").collect()} == kept
    # with more labels than the sample both learn from the same rows
    few = {r["doc_id"] for r in Q.judge(documents, labels, 60).where("kept").collect()}
    assert {r["doc_id"] for r in Q.keep(documents, labels, 60).select("doc_id").collect()} == few


def test_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = Q.judge(odd_docs, none).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    same(rows, texts)
    assert all(r["kept"] != r["base_failed"] for r in rows)  # without labels the base rules decide
    lines = spark.createDataFrame([(1, "a b\na b\n \n \n#a b\na b"), (2, "\n\n"), (3, "x x x x x")], "doc_id long, text string")
    same(Q.judge(lines, none).collect(), {r["doc_id"]: r["text"] for r in lines.collect()})
    assert Q.judge(odd_docs.limit(0), none).count() == 0
    assert Q.keep(odd_docs, none).columns == odd_docs.columns


def test_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3_000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.normal(size=3_000)) < 0.5).astype(float)
    trees = Q.fit_trees(x, y, [-1, 0, 1])
    base = rng.random((200, 3))
    for j, sign in ((0, -1), (2, 1)):
        steps = []
        for v in np.linspace(0, 1, 40):
            z = base.copy()
            z[:, j] = v
            steps.append(trees.raw(z))
        assert (sign * np.diff(np.stack(steps), axis=0) >= -1e-9).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85


def test_scoring_against_a_plain_walk():
    """Node arrays give what a walk from node to node gives."""
    rng = np.random.default_rng(4)
    x = rng.random((400, 5))
    trees = Q.fit_trees(x, (x[:, 0] + x[:, 3] > 1).astype(float), [1, 0, 0, 1, 0], trees=12)
    depth = int(np.log2(trees.leaf.shape[1]))
    for row, got in zip(x[:50], trees.score(x[:50]), strict=True):
        raw = trees.bias
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            for _ in range(depth):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            raw += leaf[node - (2**depth - 1)]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-12
