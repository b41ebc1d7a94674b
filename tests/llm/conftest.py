from __future__ import annotations

import random

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, row string, u int, v int, depth int, cell int, `a.b` int"
WORDS = "the of and that with from was her thing over under river stone cloud amber quick brown fox jumps lazy dog éclair über niño".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows and columns with clashing names."""
    rng = random.Random(3)

    def prose(n: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(n))

    base = prose(300)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, base), (7, base), (7, base), (8, base + " extra"), (9, prose(40_000)), (None, "no id here"), (10, "😀   ½ 日本語 ' 's don't\n\n\nx  y"), (11, "A" * 5000), (12, prose(120))]
    return spark.createDataFrame([(i, t, None, None, None, 1, "k", "r", 2, 3, 4, 5, 6) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
