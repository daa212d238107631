"""Tables over code points, built once in each worker."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

#: Character classes of the document statistics.
UPPER, LETTER, DIGIT, SPACE, LINE, STOP, COMMA, QUOTE, SYMBOL = range(9)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, SYMBOL, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            out[c] = UPPER
        elif kind[0] in "LM":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = DIGIT
        elif kind[0] == "Z":
            out[c] = SPACE
    for chars, kind in ((" \t", SPACE), ("\n\r\x0b\x0c  ", LINE), (".?!…", STOP), (",;:", COMMA), ("'\"()-’‘“”«»–", QUOTE)):
        out[[ord(c) for c in chars]] = kind
    return out


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@cache
def folded() -> np.ndarray:
    """0 for white space, 1 to 26 for letters by their base letter, 27 for what is left out.

    Letters of other scripts share the 26 numbers.
    """
    out = np.full(sys.maxunicode + 1, 27, np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isspace():
            out[c] = 0
        elif ch.isalpha():
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            out[c] = ord(base) - 96 if "a" <= base <= "z" else c % 26 + 1
    return out
