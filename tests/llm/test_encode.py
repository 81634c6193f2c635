"""Encoding by a tree of halves is encoding in one piece."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitspark.llm.encode import VOCABULARY, decode_corpus, decode_ids, encode_corpus, encode_text

PIECES = ["a", "b", "é", " ", "  ", "\n", "'s", "'", "r", "e", "ll", "\x85", "\x1c", " ", " ", "1", "23", "!", "?!", "日本", "😀", "<|endoftext|>", "the ", "don't", " I'll", "\t", "​", "　", "\r\n"]


@pytest.fixture(scope="module")
def library():
    """Another library's reading of the same vocabulary."""
    t = Tokenizer.from_file(str(Path(VOCABULARY).with_suffix(".json")))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def whole(library):
    return lambda text: library.encode(text, add_special_tokens=False).ids


def test_every_leaf_size(whole):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 100)))
        assert encode_text(text, leaf=rng.choice([1, 2, 3, 5, 8, 20])) == whole(text)


def test_without_any_cut(whole):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "the", "é", "1", "'s", "日", "!"]) for _ in range(rng.randint(0, 150)))
        assert encode_text(text, leaf=rng.choice([1, 2, 3, 5, 8, 20])) == whole(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60), st.integers(1, 9))
def test_any_text(whole, text, leaf):
    ids = encode_text(text, leaf=leaf)
    assert ids == whole(text) and decode_ids(ids) == text


def test_every_character(library):
    """Both libraries split and encode each character alike, whatever stands beside it."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(codes), 20_000):
        texts = [f"a{chr(c)}a {chr(c)}  {chr(c)}1{chr(c)}." for c in codes[k : k + 20_000]]
        got = [encode_text(t) for t in texts]
        assert got == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_long_texts(whole):
    for text in ("ab" * 30_000, "word " * 20_000, " " * 5000 + "x", "x" * 4000 + " y", "日本語" * 5000):
        assert encode_text(text) == whole(text) and decode_ids(encode_text(text)) == text


def test_corpus(spark, whole):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 5), (2, "", 5), (3, None, 5), (4, "<|endoftext|>", 5), (None, "x", 5), (5, "z " * 4000, 5)]
    ids = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids int"))
    assert sorted((r.doc_id, r.ids) for r in ids.collect()) == [(k, whole(t or "")) for k, t in ((1, "Hello  world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "z " * 4000))]
    assert {r.doc_id: r.text for r in decode_corpus(ids).collect()} == {1: "Hello  world", 2: "", 3: "", 4: "<|endoftext|>", 5: "z " * 4000}
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_test_document(library, spark, sf):
    """All documents of the smallest table, not a sample."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.ids for r in encode_corpus(docs).collect()}
    assert got == {k: e.ids for k, e in zip(want, library.encode_batch_fast(list(want.values()), add_special_tokens=False), strict=True)}
