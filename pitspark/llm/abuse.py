"""Abusive, hateful or sexual language: a weighted finite-state grammar over clauses.

Spelling comes first: look-alikes, invisible characters, letters spread out, doubled, masked or replaced are brought
back to the words of the lexicon. ``transducer`` then composes insults, threats, targets, negation and reported speech
(``abuse_grammar``) and reads each clause as a whole, however long; an insult needs a target, an attack on a group needs a
predicate, a sexual word needs an act or a body. A clause's score is 1 - prod(1 - weight) over the kinds found in it, a
text's score that of its worst clause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.abuse_grammar import CLASSES
from pitspark.llm.textnorm import fold
from pitspark.llm.transducer import REPORTED, Grammar

#: Score from which a text counts as containing such language.
THRESHOLD = 0.5

#: Compounds and terms of the trade whose parts only sound rude.
_HARMLESS = re.compile(
    r"\b(?:naked (?:short|shorts|shorting|call|calls|put|puts|option|options|position|swap)|dirty (?:float|price|bond)|cock-?ups?|dead cat|bear hug|stripped bonds?|strip(?:ped)? (?:coupon|bond)s?|"
    r"breast[- ]cancer|market penetration|kill switch|hostile (?:takeover|bid)|suicide rates?|sex and age|poison pill|puta(?:tive|tively)|descubierto desnudo|dick's|moby dick|essex|sussex|cocktails?|peacocks?|hancock|pig iron|adult[- ]education)\b"
)
_SPREAD = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-_*])(?:[^\W\d_]\1){2,}[^\W\d_])(?![^\W_])")
#: What a masked word holds, and the whole of it.
_MASK = re.compile(r"[a-z][@$*#%&0-9]|[@$*][a-z]{2}|[a-z]![a-z]")
_MASKED = re.compile(r"[a-z@$*#!%&0-9]*(?:[a-z][@$*#%&0-9]|[@$*][a-z]{2}|[a-z]![a-z])[a-z@$*#!%&0-9]*")
_TRIPLE = re.compile(r"([a-z])\1\1")
_STRETCHED = re.compile(r"\b\w*?([a-z])\1\1\w*")
_RUN = re.compile(r"(.)\1+")
#: A line break ends a clause after closing punctuation or as a blank line; else the line is only wrapped.
_CLAUSE = re.compile(r"[.!?;¡¿]+(?=\s|$)|…+|(?<=[:\"'”’»)\]])[^\S\n\r]*[\n\r]+|[^\S\n\r]*(?:\r\n|\r(?!\n)|\n)(?:[^\S\n\r]*(?:\r\n|\r(?!\n)|\n))+")
_TOKEN = re.compile(r"[a-z0-9]+(?:'[a-z]+)?")
_LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il"}

#: Words that hidden spellings may stand for.
_KNOWN = sorted(
    {
        *(w for k in ("INSULT", "MILD", "FOUL", "VERMIN", "PORN", "NUDE", "BODY", "GROUP", "HARM", "PLEASURE") for w in CLASSES[k].split() if len(w) > 2),
        *"shit crap hell fuck fucking fucked puta mierda hijo piece bitch sex sexo whores whore horny panties kill rot die subhuman friends brainless cages camps follarte desnudas censura thieves stupid suck lick strip braindead".split(),
    }
)
_SIZES: dict[int, list[str]] = {}
for _w in _KNOWN:
    _SIZES.setdefault(len(_w), []).append(_w)
_WHOLE = frozenset(_KNOWN)
_COLLAPSED = {_RUN.sub(r"\1", w): w for w in reversed(_KNOWN)}


@lru_cache(maxsize=100_000)
def _unmask(token: str) -> str:
    """The lexicon word that a token with masked or replaced letters stands for, else the token."""
    letters = sum(c.isalpha() for c in token)
    if len(token) < 4:
        return token
    if letters < 2 or letters * 10 < len(token) * 3:  # too few letters to guess the rest: every sign must stand for one
        if not letters or not all(c.isalpha() or c in _LEET for c in token):
            return token
        strict = re.compile("".join(c if c.isalpha() else f"[{_LEET[c]}]" for c in token))
        return next((w for w in _SIZES.get(len(token), ()) if strict.fullmatch(w)), token)
    pattern = re.compile("".join(c if c.isalpha() else f"[{_LEET[c]}]" if c in _LEET and c.isdigit() else "[a-z]" for c in token))
    for word in _SIZES.get(len(token), ()):
        if pattern.fullmatch(word):
            return word
    return token


@lru_cache(maxsize=100_000)
def _gathered(letters: str) -> str:
    """Letters that were spread out, as words: lexicon words, and single letters around them."""
    n = len(letters)
    cost, size_at = [0] * (n + 1), [1] * (n + 1)
    for k in range(1, n + 1):
        cost[k] = cost[k - 1] + 3
        for size in range(3, min(14, k) + 1):
            if cost[k - size] + 1 < cost[k] and letters[k - size : k] in _WHOLE:
                cost[k], size_at[k] = cost[k - size] + 1, size
    words, k = [], n
    while k:
        words.append(letters[k - size_at[k] : k])
        k -= size_at[k]
    return " ".join(reversed(words)) if any(len(w) > 2 for w in words) else letters


def plain_words(text: str) -> str:
    """The text folded, its hidden spellings brought back to words."""
    t = fold(text)
    t = _SPREAD.sub(lambda m: _gathered(re.sub(r"[^a-z]", "", m[0])), t)
    if "cock" in t or "naked" in t or "dirty" in t or "strip" in t or "desnudo" in t or "breast" in t or "penetration" in t or "kill" in t or "sex" in t or "dick" in t:
        t = _HARMLESS.sub(" _ ", t)
    if _MASK.search(t):
        t = _MASKED.sub(lambda m: _unmask(m[0]), t)
    return t if not _TRIPLE.search(t) else _STRETCHED.sub(lambda m: _COLLAPSED.get(_RUN.sub(r"\1", m[0]), m[0]), t)


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar()


def score_clause(clause: str) -> tuple[float, dict[str, float]]:
    """Score of a clause of folded text, and the weight of each kind."""
    kinds, reported = grammar().run(_TOKEN.findall(clause.replace("'", " ")))
    if reported:
        kinds = {k: w * REPORTED for k, w in kinds.items()}
    rest = 1.0
    for w in kinds.values():
        rest *= 1 - w
    return 1 - rest, kinds


def score_text(text: str | None) -> tuple[float, dict[str, float]]:
    """Score of the worst clause, and the greatest weight of each kind in any clause; 0 for null and blank texts."""
    if not text or not text.strip():
        return 0.0, {}
    worst, kinds = 0.0, {}
    for clause in _CLAUSE.split(plain_words(text)):
        if clause:
            score, own = score_clause(clause)
            worst = max(worst, score)
            for k, w in own.items():
                kinds[k] = max(kinds.get(k, 0.0), w)
    return worst, kinds


KINDS = ["insult", "harm", "hate", "sexual"]


def scores(documents: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, the columns in keep, score, and one column for each of KINDS) of every row of documents (doc_id, text).

    Whole texts are read, clause by clause. Null, empty and blank texts score 0. Rows keep their number: a repeated row
    is scored again. Nothing is shuffled.
    """
    fields = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = f"doc_id {fields['doc_id']}, " + "".join(f"`{c}` {fields[c]}, " for c in keep) + "score double, " + ", ".join(f"{k} double" for k in KINDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [score_text(t) for t in batch["text"]]
            out = batch.drop(columns="text")
            out["score"] = [s for s, _ in found]
            for k in KINDS:
                out[k] = [w.get(k, 0.0) for _, w in found]
            yield out

    return documents.select("doc_id", *keep, "text").mapInPandas(run, schema)


def flagged(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ids of documents that contain such language, each once."""
    return scores(documents).where((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def rates(documents: DataFrame, by: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """For each value of ``by`` (null is one): documents, those flagged, and the rate; a repeated document counts once."""
    one = scores(documents, by).groupBy("doc_id", by).agg(F.max("score").alias("score"))
    found = F.sum((F.col("score") >= threshold).cast("long"))
    return one.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), found.alias("flagged")).withColumn("rate", F.col("flagged") / F.col("documents"))
