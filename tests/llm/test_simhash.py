from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash as S
from lodestone.llm.components import connected


def plain(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps: list[int]) -> list[int]:
    to = list(range(len(fps)))

    def find(a):
        while to[a] != a:
            a = to[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                to[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_whole_table(documents, texts):
    rows = {r["doc_id"]: r for r in S.near_duplicates(documents).collect()}
    ids = sorted(texts)
    fps = [plain(texts[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i]["component_id"] for i in ids] == [ids[k] for k in brute(fps)]
    left = sorted(r["doc_id"] for r in S.one_of_each(documents).select("doc_id").collect())
    assert left == sorted({ids[k] for k in brute(fps)})


@pytest.mark.parametrize("most", [S.GROUP, 200, 40])
def test_groups_of_many_near_copies(spark, most):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    near = []
    for c in center.tolist():
        for _ in range(250):
            for b in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                c ^= 1 << b
            near.append(c)
    fps = list(dict.fromkeys(near + rng.integers(0, 1 << 63, 400, dtype=np.uint64).tolist()))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").withColumn("node", F.col("fp"))
    links = S.links(df, most=most).collect()
    assert len(links) < (15 if most > 1000 else 200) * len(fps)
    at = {f - (1 << 64) if f >> 63 else f: k for k, f in enumerate(fps)}
    assert all((fps[at[r["u"]]] ^ fps[at[r["v"]]]).bit_count() >= 0 for r in links)
    root = {r["u"]: r["v"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    got: dict = {}
    for f in at:
        got.setdefault(root.get(f, f), set()).add(at[f])
    want: dict = {}
    for k, r in enumerate(brute(fps)):
        want.setdefault(r, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(300)] + [(5, 5)]
    root = {r["u"]: r["v"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert root == {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert {by[i]["fingerprint"] for i in (1, 2, 3)} == {"0" * 16} and {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[6]["component_id"] == by[7]["component_id"] == 6 and by[None]["component_id"] is None
    left = S.one_of_each(odd_docs)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == odd_docs.columns and None in ids and 6 in ids and not {2, 3, 7} & set(ids)
    assert S.near_duplicates(odd_docs.limit(0)).count() == 0
    assert S.one_of_each(odd_docs.withColumnsRenamed({"key": "_gone", "row": "node"})).count() == left.count()
    small = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(odd_docs, most=3).collect()}
    assert small == {i: r["component_id"] for i, r in by.items()}
    twice = odd_docs.where("doc_id = 7").unionByName(odd_docs.where(F.col("doc_id") == 4))
    assert sorted(r["doc_id"] for r in S.one_of_each(twice).collect()) == [4, 7]
