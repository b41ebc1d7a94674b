from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from lodestone.llm import merkle
from tests.llm.conftest import DATA


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes, fanout=3):
    """The top of a list of nodes, and for each the siblings on its way there as (left, right)."""
    steps, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for k in range(len(nodes)):
            first = at[k] // fanout * fanout
            steps[k].append((now[first : at[k]], now[at[k] + 1 : first + fanout]))
            at[k] //= fanout
        now = [h("".join(now[k : k + fanout])) for k in range(0, len(now), fanout)]
    return now[0], steps


def plain(rows, fanout=3):
    """Result rows of op13_merkle by the contract alone."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: (sorted(groups[s], key=lambda x: x[:3]), *climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout)) for s in names}
    root, above = climb([inner[s][1] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        placed, subroot, steps = inner[s]
        for (_, _, mine, r), own in zip(placed, steps, strict=True):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            node = leaf(r, r["text"].replace("\n", "") if even and r["text"] is not None else r["text"])
            for left, right in own + up:
                node = h("".join([*left, node, *right]))
            out.append((r["doc_id"], mine, subroot, root, h("".join("".join(a + b) for a, b in own + up)), node, node == root))
    return sorted(map(str, out))


def query(docs, **kw):
    from pyspark.sql import functions as F

    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.manifest(docs, merkle.FIELDS, carry={"tampered": merkle.leaf(*(F.col(c) for c in merkle.FIELDS[:-1]), cut)}, **kw)
    node = merkle.folded(F.col("tampered"), F.col("proof"))
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), node, node == F.col("root"))


def strings(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_whole_table(spark, documents):
    rows = documents.collect()
    assert strings(merkle.op13_merkle(spark, DATA)) == plain(rows)


def test_odd_rows(odd_docs):
    assert strings(query(odd_docs)) == plain(odd_docs.collect())
    assert query(odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["sparse", "tied", "null"])
def test_ids_and_passes(spark, kind, monkeypatch):
    """Several passes, ids far apart and below zero, many rows of one id, many equal rows, sources with odd names."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "RUN", 7)
    sources = [None, "", "a", "é", "Z", "-", "1:a", "\U0001f600", "￿"]
    rows = []
    for k in range(400):
        id = {"sparse": (-1) ** k * (k * 7919) ** 4 % (1 << 62), "tied": 5, "null": None}[kind]
        rows.append((id, sources[0 if k % 2 else k // 2 % 9], "en", None if k % 5 else k, f"t{k}\n{k % 7}"))
    rows += [(77, "a", None, 1, "same\n")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert strings(query(docs, levels=2)) == plain(docs.collect())


def test_changed(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    old = spark.createDataFrame([(k, None if k < 3 else "ab"[k % 2], "en", k, f"t{k}") for k in range(10)], schema)
    new = spark.createDataFrame([(k, None if k < 3 else "ab"[k % 2], "en", k, "new" if k == 4 else f"t{k}") for k in range(10) if k != 1], schema)
    a, b = (merkle.manifest(d, merkle.FIELDS) for d in (old, new))
    found = {(r["source"], r["doc_id"], r["change"]) for r in merkle.changed(a, b).collect()}
    assert found == {(None, 1, "removed"), ("a", 4, "removed"), ("a", 4, "added")}
    assert merkle.changed(a, a).collect() == []
