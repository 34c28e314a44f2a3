"""Repairs of a model's texts: its loops are taken out, in one pass over the words."""

from __future__ import annotations

import re

import pandas as pd

from lectern.functions.markup import BLANK
from lectern.functions.vector import vectorised

#: Filler, words and blanks that close up. Fixed values.
FILLER = re.compile(r"(?:[_*~][\t\n\x0c\r ]++){3,}+[_*~]?|[_*~]{4,}")
WORD = re.compile(r"[^\W_]++(?:['’\-][^\W_]++)*+")
_WIDE = re.compile(r"[ \t\x0c\x0b]{2,}")


def alike(a: str, b: str) -> bool:
    """Equal but for case, letter by letter."""
    return a == b or len(a) == len(b) and a.casefold() == b.casefold()


def once(x: str) -> str:
    """Without words that repeat the one before after white space alone."""
    kept, told, end, last = [], 0, 0, None
    for m in WORD.finditer(x):
        gap = x[end : m.start()]
        if last is not None and gap and not gap.strip(BLANK) and alike(m[0], last):
            kept.append(x[told:end])
            told = m.end()
        else:
            last = m[0]
        end = m.end()
    return "".join(kept) + x[told:] if kept else x


def repaired(x: str) -> str:
    """Filler runs and words repeated at once go, spaces close up, and none are left at the ends."""
    return _WIDE.sub(" ", once(FILLER.sub(" ", x))).strip(BLANK)


@vectorised("string")
def repaired_udf(x: pd.Series) -> pd.Series:
    return x.map(repaired, na_action="ignore")
