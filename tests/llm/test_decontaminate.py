from __future__ import annotations

import random
import re

from lodestone.llm import decontaminate as D
from tests.llm.conftest import DATA, WORDS


def grams(text: str | None) -> set:
    words = re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute(docs, items, least=0.8):
    out = set()
    for d, text in docs:
        for i, item in items:
            want = grams(item)
            if want:
                words = re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
                n = len(next(iter(want)))
                have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
                share = len(want & have) / len(want)
                if share >= least:
                    out.add((d, i, round(share, 9)))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in df.collect()}


def test_whole_table(spark, documents, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = brute(texts.items(), items)
    assert want and found(D.contaminated(documents, bench)) == want
    assert found(D.contaminated(documents, bench, block=2_000)) == want  # in several blocks of items
    left = {r["doc_id"] for r in D.clean(documents, bench).select("doc_id").collect()}
    assert left == set(texts) - {d for d, _, _ in want}


def test_partial_short_and_odd(spark, odd_docs):
    long = {r["doc_id"]: r["text"] for r in odd_docs.collect()}[9].split()
    item = long[20_000:20_060]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (2, " ".join(item[:52] + ["zzz"] * 8)), (3, "!!".join(w.upper() for w in item)), (4, "two words"), (5, None), (6, ""), (7, "... --"), (8, "two words"), (9, " ".join(WORDS[:3] * 30))],
        "item_id long, text string",
    )
    items = [tuple(r) for r in bench.collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = brute(rows, items)
    assert {(9, 1, 1.0), (9, 3, 1.0), (5, 4, 1.0), (5, 8, 1.0)} <= want
    assert found(D.contaminated(odd_docs, bench)) == want
    assert D.contaminated(odd_docs.limit(0), bench).count() == 0 and D.contaminated(odd_docs, bench.limit(0)).count() == 0
    assert D.clean(odd_docs, bench).columns == odd_docs.columns


def test_items_of_one_to_seven_words_in_long_documents(spark):
    rng = random.Random(5)
    docs, items = [], []
    for k in range(420):
        item = " ".join(f"q{k}x{j}" for j in range(1 + k % 7))
        words = [f"w{rng.randrange(400)}" for _ in range(300)]
        words.insert((0, 150, 300)[k % 3], item)  # the first or the last window alone holds some of them
        docs.append((k, " ".join(words)))
        items.append((k, item))
    # at 80 % of items just above a power of two: 17 and 33 shingles of which 14 and 27 are there
    for k, (most, there) in enumerate([(17, 14), (33, 27)] * 60, 1000):
        item = [f"q{k}x{j}" for j in range(most + 4)]
        words = [f"w{rng.randrange(400)}" for _ in range(300)]
        docs.append((k, " ".join(words[:130] + item[: there + 4] + words[130:])))
        items.append((k, " ".join(item)))
    got = found(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == {(k, k, 1.0) for k in range(420)} | {(k, k, round(there / most, 9)) for k, (most, there) in enumerate([(17, 14), (33, 27)] * 60, 1000)}


def test_scattered_shingles(spark):
    rng = random.Random(6)
    item = [f"q{j}" for j in range(40)]
    words = [f"w{rng.randrange(400)}" for _ in range(3000)]
    far = [*words[:100], *item[:20], *words[100:2000], *item[20:], *words[2000:]]  # two halves, 32 of 36 shingles
    got = found(D.contaminated(spark.createDataFrame([(1, " ".join(far))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")))
    assert got == {(1, 1, round(32 / 36, 9))}


def test_recall_by_size(spark):
    """300 items of each number of shingles, whole and at the least containment, each in a document of 1,500 words."""
    rng = random.Random(9)
    docs, items, want = [], [], set()
    for size in (1, 2, 3, 5, 8, 9, 16, 40):
        for k in range(300):
            n = size * 1000 + k
            item = [f"q{n}x{j}" for j in range(size + 4)]
            there = size if k % 2 else D.needed(size, D.LEAST)
            words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
            at = rng.randrange(1501)
            words[at:at] = item[: there + 4]
            docs.append((n, " ".join(words)))
            items.append((n, " ".join(item)))
            want.add((n, n, round(there / size, 9)))
    got = found(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")))
    assert got == want


def test_sketches_are_bottom_k():
    mark = D.Benchmark(list(range(40)), [" ".join(f"w{i}x{j}" for j in range(5 + i)) for i in range(40)])
    for i, values in enumerate(mark.sets):
        sketch = mark.sketch(i, D.LEAST)
        assert sketch.tolist() == sorted(values.tolist())[: len(sketch)] and len(sketch) == len(values) - D.needed(len(values), D.LEAST) + 1
    # beyond small items a class asks for the lower part of a document's values alone
    assert min(int(c.bound) for c in mark.classes if c.most >= 32) < 0.6 * 2**64
