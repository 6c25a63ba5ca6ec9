"""Word stems by Porter's algorithm (1980), of words without accents, as an Arrow UDF.

Stemming needs rules over a word's letters that built-in functions lack. Texts repeat their
words, so each worker remembers the stems of words it has seen.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# Suffixes of steps 2, 3 and 4 with what takes their place.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem; words of up to two letters, and others than a to z, stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if "v" in _shape(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:-1] == w[-1:] and _shape(w)[-1:] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        found = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    found = max((s for s in STEP_4 if w.endswith(s)), key=len, default=None)
    if found:
        stem = w[: -len(found)]
        if _measure(stem) > 1 and (found != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def folded(word: str) -> str:
    """Without accents that are a part of single letters (sharp s stays)."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [porter(folded(w)) for w in ws])


def stem(tokens: Column) -> Column:
    """Stems of an array of lower-case tokens."""
    return pandas_udf(_stems, "array<string>")(tokens)
