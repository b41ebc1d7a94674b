"""Queries beside their SQL on made-up tables that the given ones have no rows like."""

from __future__ import annotations

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lodestone.operators import retrieval as R
from lodestone.plans import ORACLE_SQL, QUERIES


def plain(value) -> str:
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def both(spark, folder, name: str, **tables) -> tuple[list, list]:
    """The rows of a query and of its SQL over tables that are written to a folder: names with (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, out = QUERIES[name](spark, str(folder)), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(out.columns) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    return got, sorted(tuple(plain(r[out.columns.index(c)]) for c in columns) for r in out.fetchall())


def test_embedding_hashes_of_halfway_numbers(spark, tmp_path):
    got, want = both(spark, tmp_path, "embedding_hashes", embeddings=([(1, [0.0078125, 0.5, 0.0234375]), (2, [-0.0078125]), (3, [3.0e38, None]), (4, []), (5, None)], "vec_id long, embedding array<float>"))
    assert got == want


def _vectors(n: int, dim: int = 8):
    """Clustered vectors with exact copies."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(n, dim)) + rng.normal(size=(9, dim))[rng.integers(0, 9, n)] * 2, 1)
    v[::7] = v[0]
    rows = [(i * 5, [float(x) for x in v[i]], int(i % 7)) for i in range(n)]
    return rows, "vec_id long, embedding array<float>, label int"


_DENSE = ["knn_topk", "knn_filtered", "gold_positions", "missed_groups", "title_ceiling", "leakage", "scoring_policy", "group_metrics", "ranking_metrics", "report_by_k", "failure_taxonomy", "gold_ambiguity"]


@pytest.mark.parametrize("name", _DENSE)
def test_nearest_in_tiles(spark, tmp_path, monkeypatch, name):
    """Tiles that end inside batches, blocks of queries, ties over copies."""
    for limit, n in (("QUERY_BYTES", 1200), ("TILE_QUERIES", 7), ("TILE_ROWS", 40), ("TILE_PAIRS", 50)):
        monkeypatch.setattr(R, limit, n)
    got, want = both(spark, tmp_path, name, embeddings=_vectors(300))
    assert got == want


def test_nearest_in_bounded_memory():
    """9,000 queries against 20,000 rows stay below 200 MB; their scores in one matrix would be 1.4 GB."""
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(9000, 8)), rng.normal(size=(20_000, 8))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10_000)), pa.array(list(v[a : a + 10_000]))], ["doc_id", "v"]) for a in (0, 10_000)]
    tracemalloc.start()
    out = pa.Table.from_batches(R._nearest(np.arange(9000) + 50_000, q, 10)(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 90_000 and most < 200e6
    one = out.filter(pc.equal(out["query_id"], 50_003))
    cos = v @ q[3] / np.linalg.norm(v, axis=1) / np.linalg.norm(q[3])
    assert sorted(one["doc_id"].to_pylist()) == sorted(np.argsort(-cos)[:10].tolist())
