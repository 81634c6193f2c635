"""Held-out passages in a corpus: a broadcast set of their n-grams, scanned token windows, verified stretches.

An item's normalised n-grams (three neighbouring words, or three of four with one left open) that few other items share
are its anchors; an opening instruction or a stock phrase has none. Where so many of an item's words are shared that they
could make a leak by themselves, as a passage with several questions, all of its n-grams are anchors, however many items
share them. How many items share an n-gram is counted over all items. Every text is scanned once against the set of all
anchors; n-grams with the same owners are one class, so that many items with one passage cost as much as one until they
are verified. Where enough anchors of an item are hit, item and text are aligned word by word in bands around the hits,
in at most two stretches, and the share of the item's words found in order decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.textnorm import INVISIBLE, fold_word

#: Words in an anchor, and how many items may share one where an item has few of its own.
ANCHOR, SHARED = 3, 3
#: Share of an item's n-grams that are its own, below which shared ones are taken as well.
OWN = 0.3
#: Words without an anchor, fewer than which in an item are an instruction or a phrase and no passage.
PASSAGE = 20
#: Different anchors of an item that a text must hit, as a share of the item's words, before they are aligned: of an item with
#: anchors of its own, and of one all of whose n-grams, of both kinds, are anchors. A leak with half of its words altered has
#: about a fifth of those. And neighbours among a stretch's n-grams, as such a share, fewer than which hide it.
HITS, HITS_OF_ALL, OPEN = 0.05, 0.15, 0.03
#: Share of an item's words that a leak contains at least.
LEAST = 0.4
#: Scores of the alignment: equal words, other words, a word left out.
EQUAL, OTHER, GAP = 1.0, -1.5, -1.0
#: A stretch shorter than this many words is a common phrase.
LEAST_WORDS = 5
#: Words that may be put in between before a stretch counts as two; shorter items bear half their length.
MOST_GAP = 1_000
#: Items and characters of one broadcast set; beyond either the n-grams are joined by shuffling, with the same result.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 40_000_000

_WORD = re.compile(rf"</?[a-zA-Z][^<>]{{0,60}}>|([\w{INVISIBLE}̀-ͯ]+(?:['’\-,.][\w{INVISIBLE}̀-ͯ]+)*)")

Gram = tuple[str | None, ...]


def words_of(text: str) -> list[str]:
    """Folded words. Tags and punctuation are no words, marks inside a word join it."""
    return list(filter(None, map(fold_word, _WORD.findall(text))))


def places_of(text: str) -> list[tuple[int, int]]:
    """Where each of ``words_of`` stands."""
    return [m.span(1) for m in _WORD.finditer(text) if m[1] and fold_word(m[1])]


def _grams(words: Sequence[str], sizes: Sequence[int] = (ANCHOR,)) -> Iterator[tuple[int, Gram]]:
    """Places and n-grams: neighbours of each size, and of the full size also three words of four."""
    for n in sizes:
        yield from enumerate(zip(*(words[k:] for k in range(n)), strict=False))
    if ANCHOR in sizes:
        yield from enumerate(zip(words, words[1:], repeat(None), words[3:], strict=False))


def _own_grams(words: Sequence[str]) -> list[tuple[int, Gram]]:
    """All n-grams of an item; one of fewer words than an anchor is a single n-gram."""
    return list(_grams(words, (min(ANCHOR, len(words)),))) if words else []


def anchors_of(words: Sequence[str], owners: Mapping[Gram, int]) -> tuple[set[Gram], float]:
    """The n-grams of an item text by which it is looked for, and how many of them a text must hit; owners: how many item
    texts have an n-gram (else one)."""
    grams = _own_grams(words)
    count = [owners.get(g, 1) for _, g in grams]
    neighbours = max(0, len(words) - ANCHOR + 1) or len(grams)
    few = sum(n == 1 for n in count[:neighbours]) < OWN * len(words)
    plain = [n == 1 or (few and n <= SHARED) for n in count]
    if _has_passage([not p for p in plain[:neighbours]], len(words)):
        return {g for _, g in grams}, HITS_OF_ALL * len(words)
    return {g for (_, g), p in zip(grams, plain, strict=True) if p}, HITS * len(words)


def _has_passage(hidden: list[bool], words: int) -> bool:
    """Whether two stretches of an item with hardly an anchor (hidden: by n-gram, whether it is none) could be a leak, and
    are more than an instruction."""
    n = len(hidden)

    def longest(low: int, high: int) -> tuple[int, int]:
        """The longest part of n-grams low..high with hardly an anchor."""
        best, a, open_ = (low, low), low, 0
        for b in range(low, high):
            open_ += not hidden[b]
            while open_ and open_ >= OPEN * words:
                open_ -= not hidden[a]
                a += 1
            best = max(best, (a, b + 1), key=lambda x: x[1] - x[0])
        return best

    a, b = longest(0, n)
    more = max((longest(0, a), longest(b, n)), key=lambda x: x[1] - x[0])
    covered = sum(z - y + words - n for y, z in ((a, b), more) if z > y)
    return covered >= max(PASSAGE, LEAST * words - 1e-9)


@dataclass(frozen=True)
class Items:
    """What is broadcast: each distinct item text's words and ids, the class of each anchor, and the texts of each class."""

    words: list[list[str]]
    ids: list[list[int]]
    classes: dict[Gram, int]
    owners: list[tuple[int, ...]]
    sizes: list[int]
    need: list[float]


def index_items(rows: list[tuple[int, str | None]]) -> Items:
    """Items with equal words are one text with several ids; items without words have no text."""
    by_text: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for item_id, text in rows:
        if item_id is not None and text and (w := words_of(text)) and item_id not in by_text[tuple(w)]:
            by_text[tuple(w)].append(item_id)
    texts = list(by_text)
    count: dict[Gram, int] = defaultdict(int)
    for w in texts:
        for g in {g for _, g in _own_grams(w)}:
            count[g] += 1
    held: dict[Gram, list[int]] = defaultdict(list)
    need = []
    for k, w in enumerate(texts):
        anchors, least = anchors_of(w, count)
        need.append(least)
        for g in anchors:
            held[g].append(k)
    numbers: dict[tuple[int, ...], int] = {}
    classes = {g: numbers.setdefault(tuple(k), len(numbers)) for g, k in held.items()}
    return Items([list(w) for w in texts], [by_text[w] for w in texts], classes, list(numbers), sorted({len(g) for g in held} & {1, 2, ANCHOR}), need)


def _stretch(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[list[int], int, int]:
    """Best local alignment with text place minus item place in low..high: the item's words that are met, and the first
    and last place in the text. Kept is one score for each cell of the band, raised along the row by what gaps cost, so
    that a gap in the row is a running maximum."""
    n, wide = len(item), high - low + 1
    padded = np.full(n + wide, -9, dtype=np.int32)  # padded[x] is text[low + x]
    a, b = max(0, low), min(len(text), low + n + wide)
    if a < b:
        padded[a - low : b - low] = text[a:b]
    equal = np.lib.stride_tricks.sliding_window_view(padded, wide)[:n] == item[:, None]
    raised = np.arange(wide + 1, dtype=np.float32) * np.float32(-GAP)  # a score of zero
    score = np.empty((n + 1, wide + 1), dtype=np.float32)
    score[0], score[:, wide] = raised, raised[wide]
    adds, up, floor = np.array([OTHER, EQUAL], dtype=np.float32), np.empty(wide, dtype=np.float32), raised[:wide]
    for k in range(n):
        before, now = score[k], score[k + 1, :wide]
        np.add(before[:wide], adds[equal[k].view(np.uint8)], out=now)
        np.add(before[1:], np.float32(2 * GAP), out=up)
        np.maximum(now, up, out=now)
        np.maximum(now, floor, out=now)
        np.maximum.accumulate(now, out=now)
    score -= raised
    k, c = divmod(int(score[:, :wide].argmax()), wide)
    met, last, first = [], k - 1 + c + low, k - 1 + c + low
    while k > 0 and 0 <= c < wide and (h := score[k, c]) > 0:
        same = equal[k - 1, c]
        if h == score[k - 1, c] + (EQUAL if same else OTHER):
            k -= 1
            if same:
                met.append(k)
                first = k + c + low
        elif h == score[k - 1, c + 1] + GAP:
            k, c = k - 1, c + 1
        else:
            c -= 1
    return met[::-1], first, last


def _bands(diagonals: list[tuple[int, Gram]], pad: int) -> list[tuple[int, int]]:
    """Diagonals (with the n-gram that lies on them) within ``pad`` of each other as bands, cut where they grow too wide."""
    out: list[tuple[int, int]] = []
    own: list[tuple[int, Gram]] = []

    def close() -> None:
        if len({g for _, g in own}) > 1 or len(diagonals) == 1:
            for a in range(own[0][0], own[-1][0] + 1, 4 * pad + 1):
                out.append((a - pad, min(a + 4 * pad, own[-1][0]) + pad))

    for d in sorted(diagonals, key=lambda x: x[0]):
        if own and d[0] - own[-1][0] > pad:
            close()
            own = []
        own.append(d)
    if own:
        close()
    return out


class _Text:
    """A text's words, and what is found out about it only when it is needed."""

    def __init__(self, text: str, words: list[str] | None = None):
        self.text, self.words = text, words_of(text) if words is None else words
        self._places: list[tuple[int, int]] | None = None
        self._grams: dict[Gram, list[int]] | None = None
        self._present: set[str] | None = None

    def has(self, item: Sequence[str], least: float) -> bool:
        """Whether enough of the item's words are there at all, in whatever order."""
        if self._present is None:
            self._present = set(self.words)
        return sum(w in self._present for w in item) >= least * len(item) - 1e-9

    def diagonals(self, item: Sequence[str]) -> list[tuple[int, Gram]]:
        size = min(ANCHOR, len(item))
        if self._grams is None or size < ANCHOR:
            self._grams = defaultdict(list)
            for at, g in _grams(self.words, sorted({size, ANCHOR})):
                self._grams[g].append(at)
        return list({(j - i, g) for i, g in _own_grams(item) for j in self._grams.get(g, ())})

    def span(self, first: int, last: int) -> tuple[int, int]:
        if self._places is None:
            self._places = places_of(self.text)
        return self._places[first][0], self._places[last][1]


def _common(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one number: no alignment meets more words."""
    at: dict[int, int] = defaultdict(int)
    for k, c in enumerate(item):
        at[c] |= 1 << k
    every = (1 << len(item)) - 1
    open_ = every
    for c in text:
        m = open_ & at[c]
        open_ = ((open_ + m) | (open_ - m)) & every
    return len(item) - open_.bit_count()


def verify(item: Sequence[str], text: _Text, least: float = LEAST) -> tuple[float, list[tuple[int, int]]] | None:
    """The share of the item's words that the text has in order, in one or two stretches, and where; None below ``least``."""
    if not text.has(item, least):
        return None
    code = {w: c for c, w in enumerate(dict.fromkeys(item))}
    there = [code[w] for w in text.words if w in code]
    if _common([code[w] for w in item], there + there) < least * len(item) - 1e-9:  # twice, as stretches may be swapped
        return None
    a_codes = np.array([code[w] for w in item], dtype=np.int32)
    t_codes = np.array([code.get(w, -1) for w in text.words], dtype=np.int32)
    bands = _bands(text.diagonals(item), min(MOST_GAP, max(8, len(item) // 2)))
    order = lambda x: (-len(x[0]), x[1])
    one = min((_stretch(a_codes, t_codes, a, b) for a, b in bands), key=order, default=([], 0, 0))
    if len(one[0]) < min(LEAST_WORDS, len(item)) or 2 * len(one[0]) < least * len(item) - 1e-9:  # the second is no longer
        return None
    # a second stretch, of other words of the item and the text
    rest, other = a_codes.copy(), t_codes.copy()
    rest[one[0][0] : one[0][-1] + 1], other[one[1] : one[2] + 1] = -2, -3
    two = min((_stretch(rest, other, a, b) for a, b in bands), key=order, default=([], 0, 0))
    both = [one, two] if len(two[0]) >= LEAST_WORDS and (two[0][0] > one[0][-1] or two[0][-1] < one[0][0]) else [one]
    found = sum(len(x[0]) for x in both)
    if found < least * len(item) - 1e-9:
        return None
    return found / len(item), [text.span(x[1], x[2]) for x in both]


def find_leaks(text: str, items: Items, least: float = LEAST) -> Iterator[tuple[int, float, list[tuple[int, int]]]]:
    """(index of the item text, share of its words, character spans) for the items that the text contains."""
    own = _Text(text)
    hit: dict[int, set[Gram]] = defaultdict(set)
    get = items.classes.get
    words = own.words
    for grams in [zip(*(words[k:] for k in range(n)), strict=False) for n in items.sizes] + [zip(words, words[1:], repeat(None), words[3:], strict=False)]:
        for gram in grams:
            if (c := get(gram)) is not None:
                hit[c].add(gram)
    different: dict[int, int] = defaultdict(int)
    for c, grams in hit.items():
        for k in items.owners[c]:
            different[k] += len(grams)
    for k, n in different.items():
        if n >= items.need[k] and (found := verify(items.words[k], own, least)):
            yield k, *found


_FOUND = "share double, spans array<struct<begin:int,stop:int>>"


def _spans(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"begin": a, "stop": b} for a, b in spans]


def _clean(items: DataFrame) -> DataFrame:
    return items.select("item_id", "text").where("item_id is not null and text is not null").distinct()


def _held(items: DataFrame) -> Items | None:
    """The index of all items, or None where they are too many or too long to be broadcast."""
    clean = _clean(items)
    n, chars = clean.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return index_items([(r[0], r[1]) for r in clean.collect()]) if n <= ITEMS_AT_ONCE and chars <= CHARS_AT_ONCE else None


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null")


def _scanned(documents: DataFrame, held: Items, least: float) -> DataFrame:
    """One pass over the corpus against the broadcast index."""
    broadcast = documents.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = broadcast.value
        for batch in batches:
            out = [
                (doc_id, item_id, share, _spans(spans))
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True)
                for k, share, spans in find_leaks(text, known, least)
                for item_id in known.ids[k]
            ]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "spans"])

    return _texts(documents).mapInPandas(scan, f"doc_id long, item_id long, {_FOUND}")


def _line(gram: Gram) -> str:
    return " ".join(w or "*" for w in gram)


def _joined(documents: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The same by joins on the n-grams' hashes, for item sets of any size; texts and items meet only as candidates."""

    def worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "words": [" ".join(words_of(t)) for t in batch["text"]]})

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, _line(g)) for key, words in zip(batch["key"], batch["words"], strict=True) for g in {g for _, g in _own_grams(words.split())}]
            yield pd.DataFrame(out, columns=["key", "gram"])

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, words, shared in zip(batch["key"], batch["words"], batch["shared"], strict=True):
                own, known = words.split(), {x["gram"]: x["n"] for x in (shared if shared is not None else ())}
                owners = {g: known[_line(g)] for _, g in _own_grams(own) if _line(g) in known}
                found, need = anchors_of(own, owners)
                out += [(key, _line(g), need) for g in found]
            yield pd.DataFrame(out, columns=["key", "gram", "need"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(doc_id, _line(g)) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) for g in {g for _, g in _grams(words_of(text), (1, 2, ANCHOR))}]
            yield pd.DataFrame(out, columns=["doc_id", "gram"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(doc_id, key, found[0], _spans(found[1])) for doc_id, key, text, words in zip(batch["doc_id"], batch["key"], batch["text"], batch["words"], strict=True) if (found := verify(words.split(), _Text(text), least))]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "key", "share", "spans"])

    members = _clean(items).mapInPandas(worded, "item_id long, words string").where("words <> ''").withColumn("key", F.sha2("words", 256))
    texts = members.select("key", "words").distinct()
    own = texts.mapInPandas(grams, "key string, gram string")
    shared = own.join(own.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "gram").groupBy("key").agg(F.collect_list(F.struct("gram", "n")).alias("shared"))
    sought = texts.join(shared, "key", "left").mapInPandas(anchors, "key string, gram string, need double").select("key", F.xxhash64("gram").alias("hash"), "need")
    there = _texts(documents).mapInPandas(read, "doc_id long, gram string").select("doc_id", F.xxhash64("gram").alias("hash"))
    near = there.join(sought, "hash").groupBy("doc_id", "key").agg(F.count_distinct("hash").alias("n"), F.max("need").alias("need")).where("n >= need")
    pairs = _texts(documents).join(near.select("doc_id", "key"), "doc_id").join(texts, "key")
    found = pairs.select("doc_id", "key", "text", "words").mapInPandas(check, f"doc_id long, key string, {_FOUND}")
    return found.join(members.select("key", "item_id"), "key").select("doc_id", "item_id", "share", "spans")


def leaks(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, share, spans) for every document (doc_id, text) that contains ``least`` of an item's words (item_id,
    text) in order, in one or two stretches.

    Words are compared without case, accents, marks, look-alikes and invisible characters, so that layout doesn't
    matter; altered words cost their share. Null and blank texts contain nothing, repeated rows give no second row,
    items with the same words are all reported. The held-out set is counted before it is broadcast; beyond ITEMS_AT_ONCE
    items or CHARS_AT_ONCE characters texts and items meet by joins. The broadcast way never shuffles the corpus.
    """
    held = _held(items)
    found = _joined(documents, items, least) if held is None else _scanned(documents, held, least)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "spans")).alias("x")).select("doc_id", "item_id", "x.share", "x.spans")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    kept, at = [], 0
    for a, b in sorted(spans):
        kept.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join([*kept, text[at:]])


def without_leaks(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, text) of the documents that leak, their leaked spans cut out; one row a document, of differing texts the least.

    Where the items can be broadcast this is one pass over the corpus.
    """
    held = _held(items)
    if held is None:
        found = _joined(documents, items, least).select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("spans"))

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = [cut_out(text, [(s["begin"], s["stop"]) for s in own]) for text, own in zip(batch["text"], batch["spans"], strict=True)]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

        rows = _texts(documents).join(found, "doc_id").mapInPandas(cut, "doc_id long, text string")
    else:
        broadcast = documents.sparkSession.sparkContext.broadcast(held)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(doc_id, cut_out(text, spans)) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) if (spans := [s for _, _, own in find_leaks(text, broadcast.value, least) for s in own])]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "text"])

        rows = _texts(documents).mapInPandas(scan, "doc_id long, text string")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))
