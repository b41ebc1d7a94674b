"""BM25 of many queries by blocks, beside the scan and beside plain code."""

from __future__ import annotations

import random

import pytest

from lodestone.operators import lexical as X
from lodestone.operators import retrieval as R


def corpus(spark, n: int = 300):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(n)]
    texts[10:40] = [texts[9]] * 30  # copies, so equal scores
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(i, " ".join(texts[i].split()[:9])) for i in range(0, n, 4)] + [(7000, ""), (7001, None), (7002, "unknown")], "query_id long, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"PENDING": 40, "QUERY_TERMS": 120}])
def test_best_equal_the_scan(spark, monkeypatch, limits):
    """With and without several blocks of queries and rankings inside a task."""
    for name, n in limits.items():
        monkeypatch.setattr(X, name, n)
    docs, asked = corpus(spark)
    assert rows(X.bm25_top(docs, asked, 20)) == rows(R.top_k(R.bm25(docs, asked), 20))


def test_repeated_ids_are_one_document(spark):
    docs, asked = corpus(spark, 80)
    twice = docs.unionByName(docs.where("doc_id % 9 = 0"))
    assert rows(X.bm25_top(twice, asked, 5)) == rows(R.top_k(R.bm25(twice, asked), 5))
    assert X.bm25_top(docs.limit(0), asked, 5).count() == 0 and X.bm25_top(docs, asked.limit(0), 5).count() == 0


def test_no_row_for_each_shared_term_is_shuffled(spark, tmp_path, monkeypatch):
    """Candidates of the local ranking queries: no exchange holds a term, and no task returns more than its k best of each query."""
    from lodestone.plans import ranking_queries

    docs, asked = corpus(spark)
    seen = []
    monkeypatch.setattr(ranking_queries, "table", lambda *_: docs)
    monkeypatch.setattr(R, "top_k", lambda run, *a, f=R.top_k, **b: seen.append(run) or f(run, *a, **b))
    monkeypatch.setattr(ranking_queries.ASKED, "df", lambda *_: asked)
    assert ranking_queries._candidates(spark, str(tmp_path)).count() > 0
    assert seen and "term" not in seen[0].columns
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_fields_phrases_and_blocks(spark, monkeypatch):
    """The best weighted field of each document, boosts, and no shuffle by query and document."""
    for name, n in {"PENDING": 40, "QUERY_TERMS": 120}.items():
        monkeypatch.setattr(X, name, n)
    docs, asked = corpus(spark, 120)
    own = docs.selectExpr("'k' || doc_id AS key", "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS title", "text AS body", "CASE WHEN doc_id % 10 = 0 THEN array(doc_id, 8L) END AS held")
    got = X.bm25_fields(own, asked, "key", {"title": 3.0, "body": 1.0}, {"held": 2.0})
    want: dict = {}
    for field, w in (("title", 3.0), ("body", 1.0)):
        for r in R.bm25(own.selectExpr("key AS doc_id", f"{field} AS text"), asked).collect():
            want[r["query_id"], r["doc_id"]] = max(want.get((r["query_id"], r["doc_id"]), 0.0), w * r["score"])
    held = {r["key"]: r["held"] or [] for r in own.collect()}
    want = {(q, k): round(s + (2.0 if q in held[k] else 0.0), 6) for (q, k), s in want.items()}
    assert {(r["query_id"], r["key"]): round(r["score"], 6) for r in got.collect()} == want
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
