"""Whole texts as token ids of a public byte-level vocabulary, by a tree of joined halves.

A long text is halved again and again; the leaves are encoded, and neighbours are joined up the tree. Halves meet, where
there is one near the middle, at a sure cut: between a character that is no white space and one that is, where the
vocabulary's pre-tokenizer always cuts, whatever surrounds it. Such a seam needs nothing. At any other seam a window
around it is encoded anew, which grows on either side until it ends at a sure cut; tokens outside the window are the
same in the joined text as in the half. Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.operators.dedupe import one_per_key
from pitspark.session import ROW

#: Where the vocabulary's ranks are, unless a caller says otherwise; every executor needs the file at this path.
VOCABULARY = os.environ.get("PITSPARK_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the vocabulary's texts are split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts up to so many characters are encoded as they are.
LEAF = 1024
#: How far behind the middle a sure cut is looked for, and the first width of a window on either side of another seam,
#: in characters; it doubles while it finds no cut.
WINDOW = 64

#: The white space on which both Python and the pre-tokenizer agree; a cut lies before one of these.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n\t\r])")


class Vocabulary:
    """The encoder of a file of ranks, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encode = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_of[k] = token


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def _last_cut(text: str, a: int, b: int) -> int:
    """Where text[a:b] is cut last, growing leftwards from its end; a if nowhere."""
    width = WINDOW
    while True:
        begin = max(a, b - width)
        cuts = [m.start() for m in _CUT.finditer(text, begin, b)]
        if cuts and cuts[-1] > a:
            return cuts[-1]
        if begin == a:
            return a
        width *= 2


def _first_cut(text: str, a: int, b: int) -> int:
    """Where text[a:b] is cut first behind its begin; b if nowhere."""
    m = _CUT.search(text, a + 1, b)
    return m.start() if m else b


def _tokens_of(ids: list[int], n: int, bytes_of: list[bytes]) -> int:
    """How many of the ids make the first n bytes."""
    k = 0
    while n > 0:
        n -= len(bytes_of[ids[k]])
        k += 1
    return k


def _encode(text: str, a: int, b: int, words: Vocabulary, leaf: int) -> list[int]:
    if b - a <= leaf:
        return words.encode(text[a:b])
    middle = (a + b) // 2
    if cut := _CUT.search(text, middle, min(b, middle + WINDOW)):
        middle = cut.start()
    left, right = _encode(text, a, middle, words, leaf), _encode(text, middle, b, words, leaf)
    if not cut:
        p, q = _last_cut(text, a, middle), _first_cut(text, middle, b)
        gone = _tokens_of(left[::-1], len(text[p:middle].encode()), words.bytes_of)
        del left[len(left) - gone :]
        left += words.encode(text[p:q])
        right = right[_tokens_of(right, len(text[middle:q].encode()), words.bytes_of) :]
    left += right
    return left


def encode_text(text: str | None, path: str = VOCABULARY, leaf: int = LEAF) -> list[int]:
    """The ids of a text, exactly as if it were encoded in one piece; none for an empty or null one."""
    return _encode(text, 0, len(text), vocabulary(path), leaf) if text else []


def decode_ids(ids, path: str = VOCABULARY) -> str:
    """The text of ids: the bytes of halves of them, concatenated up the tree."""
    bytes_of = vocabulary(path).bytes_of

    def joined(a: int, b: int) -> bytes:
        if b - a <= LEAF:
            return b"".join([bytes_of[k] for k in ids[a:b]])
        return joined(a, (a + b) // 2) + joined((a + b) // 2, b)

    return joined(0, len(ids)).decode()


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.fromiter((k for row in rows for k in row), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


#: Characters whose ids are sent back in one batch.
CHARS_AT_ONCE = 2_000_000


def encode_corpus(documents: DataFrame, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text): every text whole, as it stands.

    Null and empty texts have an empty list; a document delivered twice gives one row (see
    ``one_per_key``), a null doc_id none. Texts are held in memory one batch at a time; the vocabulary is read once by each worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, n, a = batch.column(0), [], 0, 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                rows.append(encode_text(text, path, leaf))
                n += len(text or "")
                if n >= CHARS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([ids.slice(a, k + 1 - a), _lists(rows)], names=["doc_id", "ids"])
                    rows, n, a = [], 0, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([ids.slice(a), _lists(rows)], names=["doc_id", "ids"])

    own = documents.select(F.col("doc_id").cast("long"), "text", *[c for c in documents.columns if c == ROW]).where(F.col("doc_id").isNotNull())
    return one_per_key(own, "doc_id").select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of encoded documents (doc_id, ids); an empty list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids or [], path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
