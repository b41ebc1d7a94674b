from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from lodestone.llm import quality
from tests.llm import test_decontaminate, test_packing, test_pii, test_quality, test_simhash
from tests.llm.conftest import DATA


def test_stages_against_brute_force(spark, documents, tmp_path):
    """Each stage's rows are those of the plain code that its operator is tested with, on what the stage before it kept."""
    out = []
    docs = documents
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == documents.columns
        out.append(docs)
    texts = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (documents, *out[:4])]
    # quality: the base rules by plain code, the trees by the scores of the operator's query
    score = {r["doc_id"]: r["score"] for r in quality.judge(documents, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}

    def good(i: int) -> bool:
        n_words, _, _, _, repeated = test_quality.brute(texts[0][i])
        return n_words >= 50 and 100 * repeated <= 50 * n_words and score[i] >= 0.5

    assert set(texts[1]) == {i for i in texts[0] if good(i)} and len(texts[1]) < len(texts[0])
    ids = sorted(texts[1])
    assert set(texts[2]) == {ids[k] for k in test_simhash.brute([test_simhash.plain(texts[1][i]) for i in ids])} and len(texts[2]) < len(ids)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(texts[3]) == set(texts[2]) - {d for d, _, _ in test_decontaminate.brute(texts[2].items(), items)} and len(texts[3]) < len(texts[2])
    assert texts[4] == {i: test_pii.plain(t) for i, t in texts[3].items()} and texts[4] != texts[3]
    assert all(r["n_chars"] == len(r["text"]) for r in out[3].collect())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    test_packing.check(out[4].collect(), texts[4], lambda t: tok.encode(t, add_special_tokens=False).ids, 2048)
    assert C.run(spark, DATA).count() == out[4].count()


def test_odd_rows_and_empty_tables(spark, odd_docs):
    odd = odd_docs.withColumnsRenamed({"key": "pii", "row": "sequence_id"})
    for name, stage in C.STAGES:
        empty = stage(spark, odd.limit(0), DATA)
        assert empty.count() == 0, name
        got = stage(spark, odd, DATA)
        rows = got.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
            continue
        assert got.columns == odd.columns == empty.columns, name
        kept = {r["doc_id"] for r in rows}
        if name == "quality":
            assert kept <= {6, 7, 8, 9, 12}
        if name == "near_dedup":
            assert None in kept and 1 in kept and not {2, 3, 7} & kept
        if name == "decontaminate":
            assert {1, 2, 3, None} <= kept and len(rows) == odd.count()
        if name == "pii":
            assert len(rows) == odd.count() and {r["pii"] for r in rows} == {"k"} and next(r["n_chars"] for r in rows if r["doc_id"] == 1) is None
