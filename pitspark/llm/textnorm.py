"""Letters as a reader sees them: look-alikes, invisible characters and accents folded away."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ӏ": "l", "ո": "n", "ԛ": "q", "ѵ": "v", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "υ": "u", "τ": "t", "ı": "i", "ß": "ss", "ø": "o", "ł": "l",
}
#: Characters that take no room.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"


class _Fold(dict):
    """str.translate table that folds each character the first time it is met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code < 128:
            out = c.lower()
        elif c in INVISIBLE or unicodedata.combining(c):
            out = ""
        else:
            out = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(LOOK_ALIKES.get(x, x) for x in out)
        if len(self) < 100_000:
            self[code] = out
        return out


_TABLE = _Fold()


def fold(text: str) -> str:
    """The text in lower case, without accents and invisible characters, look-alikes replaced."""
    return text.translate(_TABLE)


@lru_cache(maxsize=200_000)
def fold_word(word: str) -> str:
    """A word's folded letters and digits."""
    return "".join(c for c in word.translate(_TABLE) if c.isalnum())
