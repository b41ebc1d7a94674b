from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe
from lodestone.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abstvmlredé '’\n\t  2½٣.!_-日🎉​"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_ids_are_the_library_s(library, some):
    ids, off = bpe.encoder(PATH).ids(some)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [library(t) for t in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_bins_hold(lengths):
    slot, place = P.best_two_fit(np.array(lengths, np.int64), 64)
    for b in set(slot.tolist()):
        inside = sorted((place[k], lengths[k]) for k in np.flatnonzero(slot == b))
        assert [p for p, _ in inside] == np.cumsum([0, *(s for _, s in inside)])[:-1].tolist() and sum(s for _, s in inside) <= 64
    assert len(set(slot.tolist())) <= max(1, 2 * -(-sum(lengths) // 64))


def test_two_replace_one():
    # greedy: 6 + 3 leaves 1; the pair 2 + 2 fills the gap of 4
    slot, _ = P.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert slot.tolist() == [0, 1, 0, 0]


def check(rows, texts, library, length):
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array([*library(text or ""), 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == length for r in pieces[1:]) and len(pieces) == -(-len(ids) // length)
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for o, n in sorted(inside):
            assert o == at
            at += n
        assert at <= length
    return len(bins)


def test_whole_table(documents, texts, library):
    rows = P.pack_documents(documents).collect()
    n = check(rows, texts, library, 2048)
    assert n <= 1.03 * sum(r["length"] for r in rows) / 2048 + 1


def test_odd_rows(odd_docs, library):
    rows = P.pack_documents(odd_docs, length=512).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1] and sum(r["doc_id"] == 7 for r in rows) == 2 * sum(r["doc_id"] == 6 for r in rows)
    assert P.pack_documents(odd_docs.limit(0)).count() == 0


def test_added_tokens_have_their_id():
    some = ["plain words", "one<|endoftext|>two", "<|endoftext|>", "<|endof text|>"]
    tok = Tokenizer.from_file(PATH)
    ids, off = bpe.encoder(PATH).ids(some)
    got = [ids[a:b].tolist() for a, b in zip(off, off[1:])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in some]
    assert got[2] == [tok.token_to_id("<|endoftext|>")]


def test_ids_come_back_as_they_are(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "one text"), (None, "no id"), (big + 2, "a b c"), (big, "one text"), (None, None), (-5, "x")], "doc_id long, text string").repartition(2)
    rows = P.pack_documents(docs, length=4).collect()
    assert sorted({r["doc_id"] for r in rows}, key=str) == sorted({big, None, big + 2, -5}, key=str)
    assert sum(r["doc_id"] == big and r["piece"] == 0 for r in rows) == 2 and all(isinstance(r["doc_id"], (int, type(None))) for r in rows)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 4 and sorted(o for o, _ in b)[0] == 0 for b in bins.values())
