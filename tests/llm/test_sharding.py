from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import sharding as S
from tests.llm.conftest import DATA


@pytest.mark.parametrize("limit", [3_000, 40_000, S.SHARD_BYTES])
def test_same_as_sql(documents, limit):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = sorted(con.sql(S.OP1_SQL.replace(str(S.SHARD_BYTES), str(limit))).fetchall())
    got = sorted(tuple(r) for r in S.assign(documents, limit=limit).select("doc_id", "bytes", "shard", "depth").collect())
    assert got == want


def test_shards_fit_and_are_prefixes(documents):
    rows = S.assign(documents, limit=10_000).collect()
    shards: dict[str, list[int]] = {}
    for r in rows:
        bits = bin(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(r["shard"]) and len(r["shard"]) == r["depth"]
        shards.setdefault(r["shard"], []).append(r["bytes"])
    assert all(sum(b) <= 10_000 or len(b) == 1 for b in shards.values())
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    # no bucket was split without need: two halves that would fit one shard had an oversized parent
    for s in shards:
        if s:
            assert sum(sum(b) for t, b in shards.items() if t.startswith(s[:-1])) > 10_000


def test_equal_keys_are_split(spark):
    same = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string").repartition(4)
    rows = S.assign(same, limit=450).collect()
    sizes: dict[str, int] = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
    assert len(rows) == 50 and max(sizes.values()) <= 450 and all("." in s for s in sizes)


def test_odd_rows(odd_docs):
    rows = S.assign(odd_docs, limit=1_000).collect()
    assert len(rows) == odd_docs.count() and {r["bytes"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert S.assign(odd_docs.limit(0)).count() == 0


def test_write(spark, documents, odd_docs, tmp_path):
    S.write_shards(documents, str(tmp_path / "s"), limit=50_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count() and set(documents.columns) <= set(back.columns) and back.select("shard").distinct().count() > 5
    more = odd_docs.withColumnsRenamed({"u": "h2", "v": "bytes"}).withColumn("all", F.lit(1)).withColumn("carried", F.lit("x"))
    S.write_shards(more, str(tmp_path / "t"), limit=1_000)
    again = spark.read.parquet(str(tmp_path / "t")).drop("shard")
    assert sorted(map(str, again.collect())) == sorted(map(str, more.collect()))
    with pytest.raises(ValueError):
        S.write_shards(odd_docs.withColumn("shard", F.lit(1)), str(tmp_path / "u"))


def test_second_query_splits(spark):
    rows = S.small_shards(spark, DATA).collect()
    assert max(r["depth"] for r in rows) >= 3
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert sorted(con.sql(S.SMALL_SQL).fetchall()) == sorted((r["doc_id"], r["bytes"], r["shard"], r["depth"]) for r in rows)
