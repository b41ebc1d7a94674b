from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.operators import text_index as X
from lodestone.operators import vector_index as V
from lodestone.plans.index_queries import vector_index_topk
from lodestone.sources import generations as G

DATA = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# --- vectors


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Clustered vectors with many equal rows, zero vectors, nulls and another length."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    v = [(k, (centres[k % 12] + 0.3 * rng.normal(size=8)).round(4).tolist(), k % 5) for k in range(900)]
    v += [(1000 + k, centres[0].tolist(), 1) for k in range(400)] + [(2000, [0.0] * 8, 0), (2001, None, 0), (2002, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").repartition(3)
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    V.build(df, path, keep=("label",), cells=20)
    return df, path


def asked(df):
    return df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def brute(df, where=lambda r: True, k=10):
    rows = [r for r in df.collect() if r["vec_id"] is not None and r["embedding"] is not None and len(r["embedding"]) == 8]
    out = []
    for q in rows:
        if q["vec_id"] % 20:
            continue
        near = []
        for r in rows:
            if r["vec_id"] != q["vec_id"] and where(r):
                a, b = np.array(q["embedding"]), np.array(r["embedding"])
                size = np.sqrt((a @ a) * (b @ b))
                near.append((-round(1 / (1 + max(0.0, 1 - (a @ b / size if size else 0.0))), 6), r["vec_id"]))
        out += [(q["vec_id"], d, -s, n) for n, (s, d) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def test_exact_search_against_brute_force(spark, vectors):
    df, path = vectors
    got = V.search(spark, path, asked(df), exact=True, probes=1)
    want = brute(df)
    assert [r[:2] for r in rows_of(got.select("query_id", "doc_id"))] == [r[:2] for r in sorted((q, d) for q, d, _, _ in want)]
    assert np.allclose([r[2] for r in rows_of(got)], [r[2] for r in want], atol=2e-6)
    few = V.search(spark, path, asked(df), k=3, exact=True, probes=2, where=F.col("label") == 3)
    assert {(r["query_id"], r["doc_id"]) for r in few.collect()} == {(q, d) for q, d, _, _ in brute(df, lambda r: r["label"] == 3, 3)}


def test_only_probed_cells_are_read(spark, vectors):
    df, path = vectors
    part = V.probed(spark, path, {2, 5})
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters:")[1][:60]
    assert len(part.inputFiles()) < len(spark.read.parquet(f"{path}/rows").inputFiles()) or part.rdd.getNumPartitions()
    metrics = part.select("doc_id").collect() and part._jdf.queryExecution().executedPlan()
    assert metrics is not None and {r["cell"] for r in part.select("cell").distinct().collect()} <= {2, 5}
    folders = G.Folder(spark, f"{path}/rows").names()
    assert sum(n.startswith("cell=") for n in folders) > 10 and "cell=-1" in folders


def test_recall_of_probed_cells(spark):
    got = {(r["query_id"], r["doc_id"]) for r in vector_index_topk(spark, DATA).collect()}
    index = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = {(r["query_id"], r["doc_id"]) for r in R.knn(index, index.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_added_rows_are_found(spark, vectors, tmp_path):
    df, _ = vectors
    path = str(tmp_path / "more")
    V.build(df.where("vec_id % 3 <> 0"), path, keep=("label",), cells=9)
    V.add(df.where("vec_id % 3 = 0"), path, keep=("label",))
    got = V.search(spark, path, asked(df), exact=True)
    assert {(r["query_id"], r["doc_id"]) for r in got.collect()} == {(q, d) for q, d, _, _ in brute(df)}


def test_large_cells_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FILE_ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together again
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    V.build(df, str(tmp_path / "one"), cells=4)
    assert len(spark.read.parquet(str(tmp_path / "one/rows")).inputFiles()) >= 3
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    empty = df.limit(0)
    V.build(empty, str(tmp_path / "none"))


# --- words


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(200)]
    weight = 1 / np.arange(1, 201)
    texts = {k: " ".join(rng.choice(words, size=int(rng.integers(1, 80)), p=weight / weight.sum())) for k in range(700)}
    texts |= {900: None, 901: "", 902: "!!", 903: "Only here lies xyzzy"}
    queries = spark.createDataFrame([(1, "w0 w1 w50"), (2, "xyzzy w0"), (3, "nothing known"), (4, "w150 w150 w3 w199"), (5, None), (6, "")], "query_id int, query string")
    return texts, queries


def plain(spark, texts, queries, k=10):
    return rows_of(R.top_k(R.bm25(docs_of(spark, texts), queries), k).select("query_id", "doc_id", "score", "rank"))


def test_search_equals_the_scan(spark, corpus, tmp_path):
    texts, queries = corpus
    path = str(tmp_path / "words")
    X.build(docs_of(spark, texts), path, buckets=16, zone_docs=20)
    for k, first in ((10, 2), (1, 1), (900, 4)):
        assert rows_of(X.search(spark, path, queries, k, first=first).select("query_id", "doc_id", "score", "rank")) == plain(spark, texts, queries, k)


def test_update_rewrites_touched_buckets_only(spark, corpus, tmp_path):
    texts, queries = corpus
    path = str(tmp_path / "words")
    X.build(docs_of(spark, texts), path, buckets=64, zone_docs=20)
    before = X._manifest(spark, path)[1]["folders"]
    files = {f: G.Folder(spark, f).fs.getFileStatus(G.Folder(spark, f).root).getModificationTime() for f in (f"{path}/postings/{n}/bucket={b}" for b, n in before.items())}
    changed = {903: "plugh w0", 950: "w1 w1 w1"}
    touched = X.update(path, docs_of(spark, changed), spark.createDataFrame([(5,), (7,)], "doc_id long"))
    after = X._manifest(spark, path)[1]["folders"]
    assert {int(b) for b in before if after.get(b) != before[b]} <= touched and 0 < len(touched) < 64
    assert all(after[b] == before[b] for b in before if int(b) not in touched)
    assert all(G.Folder(spark, f).fs.getFileStatus(G.Folder(spark, f).root).getModificationTime() == t for f, t in files.items())
    now = {k: v for k, v in texts.items() if k not in (5, 7)} | changed
    assert rows_of(X.search(spark, path, queries).select("query_id", "doc_id", "score", "rank")) == plain(spark, now, queries)
    X.prune(spark, path)
    assert rows_of(X.search(spark, path, queries).select("query_id", "doc_id", "score", "rank")) == plain(spark, now, queries)


def test_only_the_terms_folders_are_read(spark, corpus, tmp_path):
    texts, _ = corpus
    path = str(tmp_path / "words")
    X.build(docs_of(spark, texts), path, buckets=64, zone_docs=20)
    _, manifest = X._manifest(spark, path)
    buckets = {r[0] for r in spark.createDataFrame([("w1",), ("w2",)], "t string").select(X._bucket(F.col("t"), 64)).collect()}
    read = X._postings(spark, path, manifest, buckets).inputFiles()
    assert read and {f.split("bucket=")[1].split("/")[0] for f in read} == {str(b) for b in buckets}


def test_no_documents_and_other_tokens(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a b")], "query_id int, query string")
    X.build(docs_of(spark, {1: None}).limit(0), str(tmp_path / "none"))
    assert X.search(spark, str(tmp_path / "none"), queries).collect() == []
    X.build(docs_of(spark, {1: "a b", 2: "b"}), str(tmp_path / "two"), T.tokens)
    assert [r["doc_id"] for r in X.search(spark, str(tmp_path / "two"), queries).orderBy("rank").collect()] == [1, 2]


# --- generations


def test_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "table")
    G.publish(spark.range(3), root)
    seen = G.current(spark, root).version
    staged = [G.stage(spark.range(n), root) for n in (5, 7)]
    results = []

    def go(name):
        try:
            results.append(G.move(spark, root, name, seen))
        except G.Conflict:
            results.append(None)

    threads = [threading.Thread(target=go, args=(s,)) for s in staged]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [r for r in results if r]
    assert len(won) == 1 and G.current(spark, root) == won[0] and G.read(spark, root).count() in (5, 7)
    with pytest.raises(G.Conflict):
        G.move(spark, root, staged[0], None)


def test_a_reader_keeps_its_generation(spark, tmp_path):
    root = str(tmp_path / "table")
    G.publish(spark.range(3), root)
    reader = G.read(spark, root)
    G.publish(spark.range(9), root)
    assert reader.count() == 3 and G.read(spark, root).count() == 9 and G.read(spark, root, 1).count() == 3


def test_rollback_validation_and_pruning(spark, tmp_path):
    root = str(tmp_path / "table")
    assert G.current(spark, root) is None and G.rollback(spark, root) is None and G.pending(spark, root) == []
    with pytest.raises(ValueError):
        G.read(spark, root)
    for n in (1, 2, 3):
        G.publish(spark.range(n), root)
    with pytest.raises(ValueError):
        G.publish(spark.range(4), root, validate=lambda df: df.count() > 4)
    assert G.read(spark, root).count() == 3 and len(G.Folder(spark, root).names("data")) == 3
    gone = G.prune(spark, root, 2)
    assert len(gone) == 1 and gone[0] not in G.Folder(spark, root).names("data")
    assert G.rollback(spark, root).version == 4 and G.read(spark, root).count() == 2
    assert G.rollback(spark, root) is None  # the first was pruned
    G.publish(spark.range(5), root)
    assert [p.action for p in G.history(spark, root)] == ["publish"] * 3 + ["rollback", "publish"]
    assert G.rollback(spark, root) and G.read(spark, root).count() == 2


def test_sync(spark, tmp_path):
    root = str(tmp_path / "store")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    assert G.sync(a, root, ["id"]) == {"added": 3, "changed": 0, "deleted": 0, "same": 0}
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "id int, v string")
    assert G.sync(b, root, ["id"]) == {"added": 1, "changed": 1, "deleted": 1, "same": 1}
    assert rows_of(G.read(spark, root).fillna("-")) == [(1, "x"), (2, "-"), (4, "z")]


def test_terms_are_counted_where_documents_are_read(spark):
    """No occurrence is shuffled: a row for each document and distinct term leaves the scan. Repeated ids are one document."""
    texts = [(1, "a b a a b"), (2, ""), (3, None), (4, "c"), (4, "c")]
    docs = spark.createDataFrame(texts[:3], "doc_id long, text string")
    entries = X._entries(docs, T.tokens, 4, 2)
    assert "hashpartitioning" not in entries._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["term"], r["tf"], r["dl"]) for r in entries.collect()} == {(1, "a", 3, 5), (1, "b", 2, 5), (1, "", 1, 5), (2, "", 1, 0), (3, "", 1, 0)}
    again = X._entries(spark.createDataFrame(texts, "doc_id long, text string"), T.tokens, 4, 2)
    assert {(r["term"], r["tf"], r["dl"]) for r in again.where("doc_id = 4").collect()} == {("c", 2, 1), ("", 2, 1)}
