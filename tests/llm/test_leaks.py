"""Leaks planted in made-up texts, and texts that only look alike."""

import random

import pytest

from pitspark.llm.leaks import find_leaks, index_items, leaks, without_leaks, words_of

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 8))) for _ in range(4000)]
OPENING = "Read the following excerpt and answer the question below."
ITEMS = [(k, (OPENING + " " if k % 2 else "") + " ".join(RNG.choice(WORDS) for _ in range(60))) for k in range(40)]
FILL = lambda n: " ".join(RNG.choice(WORDS[:500]) for _ in range(n))


@pytest.fixture(scope="module")
def index():
    return index_items(ITEMS)


def found(text, index):
    return {(index.ids[k][0]): share for k, share, _ in find_leaks(text, index)}


def test_whole_partial_and_two_stretches(index):
    w = ITEMS[4][1].split()
    assert found(FILL(30) + " " + ITEMS[4][1] + " " + FILL(30), index) == {4: 1.0}
    assert set(found(FILL(30) + " " + " ".join(w[20:46]) + " " + FILL(30), index)) == {4}
    assert set(found(" ".join(w[:14]) + " " + FILL(400) + " " + " ".join(w[40:54]), index)) == {4}
    assert found(" ".join(w[:20]) + " " + FILL(30), index) == {}
    assert found(" ".join(reversed(w)), index) == {}


def test_alterations(index):
    w = ITEMS[7][1].split()
    changed = [("same" if k % 9 == 4 else x) for k, x in enumerate(w)]
    for text in (" ".join(changed), " ".join(w).upper(), "\n> ".join(w), " ".join(f"<b>{x}</b>,<br/>" for x in w), " ".join(x.replace("o", "о").replace("a", "а") for x in w), "​".join([" ".join(w)[:100], " ".join(w)[100:]])):
        assert set(found(FILL(20) + " " + text, index)) == {7}


def test_common_opening_is_no_leak(index):
    assert found(OPENING + " " + FILL(200), index) == {}


def test_words():
    assert words_of("Front-loaded, the <b>chapel's</b>  6,850 Café​s <br/>") == ["frontloaded", "the", "chapels", "6850", "cafes"]


def test_corpus(spark):
    docs = [(1, "x " + ITEMS[3][1], "a"), (2, None, "a"), (3, "   ", "a"), (1, "x " + ITEMS[3][1], "a"), (None, ITEMS[3][1], "a"), (4, FILL(50) + " " + ITEMS[5][1] + " tail", "a"), (5, FILL(40_000), "a")]
    items = [*ITEMS, (103, ITEMS[3][1].upper()), (104, None), (105, ""), (106, " , ")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = leaks(d, i)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1, 3), (1, 103), (4, 5)} and out.count() == 3
    cut = {r.doc_id: r.text for r in without_leaks(d, i).collect()}
    assert cut[1].strip() == "x" and cut[4].strip().endswith("tail") and set(cut) == {1, 4}
    assert leaks(d.limit(0), i).count() == leaks(d, i.limit(0)).count() == 0


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr("pitspark.llm.leaks.ITEMS_AT_ONCE", 7)
    d = spark.createDataFrame([(k, t) for k, t in ITEMS], "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(d, i).collect()} == {(k, k) for k, _ in ITEMS}
