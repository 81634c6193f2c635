"""Held-out items that share a passage, and anchors that don't depend on how the items are split."""

import random

import pytest

from pitspark.llm.leaks import find_leaks, index_items, leaks

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 8))) for _ in range(4000)]
some = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
PASSAGE, HALF, OPENING = some(80), some(40), "Read the following excerpt and answer the question below."
ITEMS = [(k, f"{OPENING} {PASSAGE} {some(12)}") for k in range(6)]
ITEMS += [(10 + k, f"{HALF} {some(40)}") for k in range(5)]
ITEMS += [(20 + k, f"{OPENING} {some(60)}") for k in range(6)]
ITEMS += [(30 + k, f"{OPENING} {some(6)}") for k in range(6)]
DOCS = [(1, f"{some(50)} {PASSAGE} {some(50)}"), (2, f"{some(50)} {HALF} {some(50)}"), (3, f"{OPENING} {some(90)}"), (4, f"{some(9)} {ITEMS[12][1]}"), (5, some(90))]
WANT = {*((1, k) for k in range(6)), *((2, 10 + k) for k in range(5)), (4, ITEMS[12][0])}


@pytest.mark.parametrize("at_once", [1000, 4])
def test_shared_passage(spark, monkeypatch, at_once):
    monkeypatch.setattr("pitspark.llm.leaks.ITEMS_AT_ONCE", at_once)
    d, i = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(d, i).collect()} == WANT


@pytest.mark.parametrize("twins", [5, 50, 500])
def test_twins(spark, monkeypatch, twins):
    """Items of sixty words that differ in the last one: a copy of one holds nearly all words of every other."""
    body = some(59)
    items = [(k, f"{body} w{k}x") for k in range(twins)] + ITEMS
    docs = [(1, f"{some(30)} {items[3][1]} {some(30)}"), (2, " ".join(body.split()[:50])), (3, " ".join(body.split()[:15]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k + 1000 * (n < twins), t) for n, (k, t) in enumerate(items)], "item_id long, text string")
    want = {(doc, 1000 + k) for doc in (1, 2) for k in range(twins)}
    for at_once in (20_000, 7):
        monkeypatch.setattr("pitspark.llm.leaks.ITEMS_AT_ONCE", at_once)
        rows = [(r.doc_id, r.item_id, r.share) for r in leaks(d, i).collect()]
        assert {r[:2] for r in rows} == want and len(rows) == len(want)
        assert all(share > 0.8 for *_, share in rows)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2, 0.3])
def test_recall_of_altered_words(rate):
    rng = random.Random(int(rate * 100))
    found = total = 0
    index = index_items([(k, some(rng.randint(15, 120))) for k in range(120)])
    for k, words in enumerate(index.words):
        text = " ".join(some(1) if rng.random() < rate else w for w in words)
        total += 1
        found += k in {x for x, *_ in find_leaks(f"{some(80)} {text} {some(80)}", index)}
    assert found / total >= 0.9


def test_each_third_word_altered():
    index = index_items([(k, some(60)) for k in range(20)])
    for k, words in enumerate(index.words):
        text = " ".join(some(1) if n % 3 == 2 else w for n, w in enumerate(words))
        assert {x for x, *_ in find_leaks(f"{some(80)} {text} {some(80)}", index)} == {k}


def test_long_items_and_texts():
    """A text that repeats an item a thousand times, and an item of many words, in bounded memory."""
    index = index_items([(0, some(500)), (1, some(20_000))])
    assert {x: round(share, 3) for x, share, _ in find_leaks(" ".join([" ".join(index.words[0])] * 1000), index)} == {0: 1.0}
    half = index.words[1][3000:13_000]
    assert {x: round(share, 2) for x, share, _ in find_leaks(f"{some(500)} {' '.join(half)} {some(500)}", index)} == {1: 0.5}


def test_far_stretches_of_one_item():
    index = index_items([(0, some(100)), (1, some(100))])
    w = index.words[0]
    text = " ".join([*w[60:85], some(3000), *w[10:30]])
    assert {x: share for x, share, _ in find_leaks(text, index)} == {0: 0.45}
