from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from lodestone.llm import toxicity as T


def corpus(spark, n=600):
    rng = random.Random(8)
    plain = "the river ran over smooth stones and under a bridge while birds sang in tall green trees near water".split()
    bad, ends = ["grumlo", "snarvi", "blotka"], ["st", "en", "ar", "ost", "ing"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(ends))
        docs.append((i, " ".join(words), None))
        labels.append((i, None, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    rows = T.score(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    test = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    # labels of held-out documents change nothing
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r["doc_id"]: r["score"] for r in T.score(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_scores_do_not_depend_on_neighbours(spark):
    docs, labels = corpus(spark, 200)
    model = T.fit_model(T.gram_counts(docs.drop("toxic").join(labels, "doc_id")))
    texts = [r["text"] for r in docs.limit(20).collect()] + ["", "é", "  x "]
    whole = np.concatenate([x for _, _, x in T.features(model, pa.array(texts))])
    alone = np.concatenate([x for t in texts for _, _, x in T.features(model, pa.array([t]))])
    assert np.allclose(whole, alone)


def test_gram_counts(spark):
    df = spark.createDataFrame([("Ab, ab", 1), ("ab", 0)], "text string, toxic int")
    got = {(r["toxic"], r["gram"]): r["n"] for r in T.gram_counts(df).collect()}
    key = lambda s: sum(c << 8 * k for k, c in enumerate(reversed(s.encode())))
    assert got == {(1, key("    a")): 1, (1, key("   ab")): 1, (1, key("  ab ")): 1, (1, key(" ab a")): 1, (1, key("ab ab")): 1, (0, key("    a")): 1, (0, key("   ab")): 1}


def test_letters_keep_apart(spark):
    """Letters beyond the first pages of Unicode do not share numbers, with each other or with the blank."""
    df = spark.createDataFrame([(t, 0) for t in ("丠", "丁", "\u4c20", " ", "й")], "text string, toxic int")
    spelled = {t.encode()[: k + 1] for t in ("丠", "丁", "\u4c20", "й") for k in range(len(t.encode()))}
    assert T.gram_counts(df).count() == len(spelled)


def test_odd_rows(spark, odd_docs):
    docs, labels = corpus(spark, 120)
    none = labels.limit(0)
    rows = T.score(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and {r["predicted"] for r in rows} == {0}
    assert T.score(odd_docs.limit(0), labels).count() == 0
    assert len(T.score(odd_docs, labels).collect()) == odd_docs.count()


def kneser_ney(texts: dict[int, list[str]]):
    """P(class, gram of five letters) by plain dictionaries."""
    levels = {c: {5: {}} for c in texts}
    for c, some in texts.items():
        for text in some:
            padded = "    " + text
            for k in range(len(text)):
                gram = padded[k : k + 5]
                levels[c][5][gram] = levels[c][5].get(gram, 0) + 1
        for k in (4, 3):
            levels[c][k] = {}
            for gram in levels[c][k + 1]:
                levels[c][k][gram[1:]] = levels[c][k].get(gram[1:], 0) + 1
    threes = set(levels[0][3]) | set(levels[1][3])
    pairs = {}
    for gram in threes:
        pairs[gram[1:]] = pairs.get(gram[1:], 0) + 1

    def two(gram):
        alone = (sum(p[1] == gram[1] for p in pairs) + 1) / (len(pairs) + 256)
        after = [n for p, n in pairs.items() if p[0] == gram[0]]
        return (max(pairs.get(gram, 0) - 0.75, 0) + 0.75 * len(after) * alone) / sum(after) if after else alone

    def p(c, gram):
        if len(gram) == 2:
            return two(gram)
        after = [n for g, n in levels[c][len(gram)].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(c, gram[1:])
        return (max(levels[c][len(gram)].get(gram, 0) - 0.75, 0) + 0.75 * len(after) * p(c, gram[1:])) / sum(after)

    return levels, p


def test_grams_do_not_share_cells(spark):
    texts = {0: ["the river ran over stones", "over the river"], 1: ["grumlo the river", "grumlost over"]}
    model = T.fit_model(T.gram_counts(spark.createDataFrame([(t, c) for c, some in texts.items() for t in some], "text string, toxic int")))
    levels, p = kneser_ney(texts)
    number = lambda g: sum(ord(x) << 8 * k for k, x in enumerate(reversed(g)))
    letters = lambda n: "".join(chr(n >> 8 * k & 255) for k in range(4, -1, -1))
    seen = sorted({*levels[0][5], *levels[1][5]})
    # grams that were never seen, equal to seen ones modulo the 1,048,573 cells of a fixed table
    unseen = [letters(number(g) + 1_048_573 * m) for g in seen for m in (1, 2**10 + 7)]
    grams = [*seen, *unseen]
    want = [np.log(p(1, g)) - np.log(p(0, g)) for g in grams]
    assert np.allclose(model.ratios(np.array([number(g) for g in grams])), want, atol=1e-4)


def test_final_model_counts_the_fold(spark, monkeypatch):
    docs, labels = corpus(spark, 120)
    fit, seen = T.fit_model, []
    as_dict = lambda counts: {(r["toxic"], r["gram"]): r["n"] for r in counts.collect()}
    monkeypatch.setattr(T, "fit_model", lambda counts: seen.append(as_dict(counts)) or fit(counts))
    T.score(docs, labels)
    assert seen[-1] == as_dict(T.gram_counts(docs.drop("toxic").join(labels, "doc_id").where(~T.held_out())))


def test_a_bounded_model_keeps_the_mass_of_what_it_leaves_out(spark):
    """With a few grams of a class and order only, all conditional probabilities of a context still sum to 1, and the grams seen most are as before."""
    docs, labels = corpus(spark, 200)
    counts = T.gram_counts(docs.drop("toxic").join(labels, "doc_id"))
    whole, few = T.fit_model(counts), T.fit_model(counts, most=40)
    assert max(len(x[0]) for side in few.kept for x in side) <= 40 < max(len(x[0]) for side in whole.kept for x in side)
    for c in (0, 1):
        keys, shares = few.kept[c][-1]
        place = np.searchsorted(whole.kept[c][-1][0], keys)
        assert np.allclose(whole.kept[c][-1][1][place], shares)
    for model in (whole, few):
        for context in np.unique(whole.kept[1][-1][0] >> T.WIDE)[::50]:
            after = (context << T.WIDE) + np.arange(256)
            assert np.allclose(model.likelihoods(after).sum(1), 1, atol=2e-3)


def both_ways(docs, labels, monkeypatch):
    """Scores as the query gives them, and with a model of all grams in arrays, however many."""
    ours = T.score(docs, labels).collect()
    fit = T.fit_model
    monkeypatch.setattr(T, "fit_model", lambda counts: fit(counts, 1 << 40))
    whole = T.score(docs, labels).collect()
    by_id = lambda rows: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["score"], r["held_out"]) for r in rows)
    return by_id(ours), by_id(whole)


def test_more_grams_than_a_task_holds_leave_nothing_out(spark, monkeypatch):
    """Ordinary text of over MODEL_GRAMS different grams, most of them seen once."""
    rng = np.random.default_rng(5)
    docs = [(i, bytes(rng.integers(97, 123, 100_000, np.uint8)).decode()) for i in range(40)]
    # parts of what was seen, so rare grams decide
    docs += [(100 + i, docs[i % 40][1][500 * i : 500 * i + 300] + " grumlo snarvi" * (i % 3 == 0)) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ours, whole = both_ways(frame, spark.createDataFrame([(i, int(i >= 100 and i % 3 == 1)) for i, _ in docs], "doc_id long, toxic int"), monkeypatch)
    assert len(ours) == len(docs) and np.allclose([r[2] for r in ours], [r[2] for r in whole], atol=1e-4)


def test_grams_looked_up_by_joins(spark, odd_docs, monkeypatch):
    """Forty grams in arrays and all others by joins, over odd rows and copies: as with all in arrays."""
    docs, labels = corpus(spark, 150)
    docs = docs.drop("toxic").unionByName(odd_docs.select("doc_id", "text")).unionByName(docs.limit(30).drop("toxic"))
    monkeypatch.setattr(T, "MODEL_GRAMS", 40)
    monkeypatch.setattr(T, "KNOWN_GRAMS", 40, raising=False)
    ours, whole = both_ways(docs, labels, monkeypatch)
    assert [r[:2] for r in ours] == [r[:2] for r in whole] and np.allclose([r[2] for r in ours], [r[2] for r in whole], atol=1e-4)


def test_ratios_by_joins(spark, monkeypatch):
    """Seen and unseen grams, against plain dictionaries."""
    monkeypatch.setattr(T, "MODEL_GRAMS", 10)
    texts = {0: ["the river ran over stones", "over the river"], 1: ["grumlo the river", "grumlost over"]}
    model = T.fit_model(T.gram_counts(spark.createDataFrame([(t, c) for c, some in texts.items() for t in some], "text string, toxic int")))
    levels, p = kneser_ney(texts)
    number = lambda g: sum(ord(x) << 8 * k for k, x in enumerate(reversed(g)))
    grams = sorted({*levels[0][5], *levels[1][5], "zzzzz", "xrive", "overq", "the s"})
    got = {r["gram"]: r["ratio"] for r in model.ratios(spark.createDataFrame([(number(g),) for g in grams], "gram long")).collect()}
    assert np.allclose([got[number(g)] for g in grams], [np.log(p(1, g)) - np.log(p(0, g)) for g in grams], atol=1e-4)
