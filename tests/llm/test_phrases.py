from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import phrases
from tests.llm.conftest import DATA

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, longest=3, least=10, inside=50, top=2000):
    """Result rows of op11_phrases by the contract alone. rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        found = []
        for p, a in good.items():
            if p in covered and 100 * covered[p] >= inside * a:
                continue
            score, cut = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_whole_table(spark, documents):
    want = plain([(r["lang"], r["text"]) for r in documents.collect()])
    assert sorted(map(tuple, phrases.op11_phrases(spark, DATA).collect())) == want
    assert len(want) > 100


def test_odd_rows(odd_docs):
    got = phrases.phrases(odd_docs, least=2, top=300)
    assert sorted(map(tuple, got.collect())) == plain([(r["lang"], r["text"]) for r in odd_docs.collect()], least=2, top=300)
    assert phrases.phrases(odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [phrases.MOST_BITS, 64])
def test_borders_ties_and_shared_bits(spark, monkeypatch, bits):
    """Pieces, overlaps, ties by bytes, null languages, longer phrases; a table of one word of bits changes nothing."""
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "LEAST_BITS", min(bits, phrases.LEAST_BITS))
    monkeypatch.setattr(phrases, "BLOCK", 200)
    texts = ["A a\ta A a a", "x y. x y, X y\nx y;x y:x y", "É b é b é b É b", "p q r s p q r s p q r s", "zz yy\x0bzz yy\x0czz\x0dyy zz", "...", " ", None, "w" * 300 + " v"]
    rows = [(lang, t) for lang in ("en", None, "") for t in texts for _ in range(4)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for longest in (2, 3, 4):
        got = phrases.phrases(docs, longest=longest, least=4)
        assert sorted(map(tuple, got.collect())) == plain(rows, longest=longest, least=4)


def test_products_pass_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    levels = [[("en", "a", big), ("en", "b", big - 7)], [("en", "a b", big - 9)], []]
    frames = [spark.createDataFrame(x, "lang string, phrase string, f long") for x in levels]
    monkeypatch.setattr(phrases, "levels", lambda *_: (spark.createDataFrame([("en", 9)], "lang string, n long"), frames))
    (row,) = phrases.phrases(None).collect()
    assert row["score"] == 1_000_000 * (big - 9) ** 2 // (big * (big - 7))


def test_frequent_phrases_have_their_bits(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63, 5000)
    bits = phrases.frequent_bits(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    other = rng.integers(-(2**63), 2**63, 5000)
    assert phrases._has(bits, keys.view(np.uint64)).all() and phrases._has(bits, other.view(np.uint64)).mean() < 0.1
    assert len(bits) * 64 <= 32 * 5000 and np.unpackbits(bits.view(np.uint8)).sum() <= 5000


def test_keys_tell_languages_and_words_apart():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", None, "en"]), pa.array(["a b a b", "a b", "ab a. b a"])], ["lang", "text"])
    (block,) = phrases._blocks(batch)
    keys = dict(zip(zip(block.lang[block.starts(2)], block.at[block.starts(2)], block.at[block.starts(2) + 1]), block.keys(2, block.starts(2)).tolist()))
    assert len(set(keys.values())) == len(keys) == 4  # en: a b, b a, ab a; und: a b
