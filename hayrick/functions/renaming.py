"""Private words replaced in texts for publication, in the case and at the edges of names.

All words are looked for at once, the longest first, whatever their case; what a replacement
brings in is not looked at again. A hit counts where a name ends after it (no small letter or
digit follows) and begins with it: in the middle of a word only a capital begins a name, and a
hit all in capitals before another capital is part of a longer word. The replacement takes
the hit's case: all capitals, a capital first, or as it is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def renamer(terms: dict[str, str]) -> Callable[[str], str]:
    """A function of texts for a vocabulary; ValueError for an empty word."""
    if not all(isinstance(k, str) and k and isinstance(v, str) and v for k, v in terms.items()):
        raise ValueError("words and their replacements are texts that aren't empty")
    if not terms:
        return lambda text: text
    known = sorted(terms, key=lambda k: (-len(k), k))
    # A longer word that isn't at an edge must not hide a shorter one that is: each alternative has its own edge.
    pattern = re.compile("|".join(f"({re.escape(k)})(?-i:(?![a-z0-9]))" for k in known), re.IGNORECASE)

    def rename(text: str) -> str:
        out, at, look = [], 0, 0
        while m := pattern.search(text, look):
            hit, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            inside = (before.islower() or before.isdigit()) and not hit[0].isupper()
            if inside or hit.isupper() and after.isupper():
                look = m.start() + 1
                continue
            new = terms[known[m.lastindex - 1]]
            out += [text[at : m.start()], new.upper() if hit.isupper() else new[:1].upper() + new[1:] if hit[0].isupper() else new]
            at = look = m.end()
        return "".join([*out, text[at:]])

    return rename


def renamed(text: Column, terms: dict[str, str]) -> Column:
    """The texts of a column with the vocabulary's words replaced; null stays null. The vocabulary travels with the plan and is compiled once a task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rename = renamer(terms)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else rename(t))

    renamer(terms)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, "string")(text)
