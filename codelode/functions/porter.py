"""The Porter (1980) stemmer, applied to a vocabulary and not to texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "(?:[^aeiouy]|(?:^|(?<=[aeiou]))y)", "[aeiouy]"


def _form(word: str) -> str:
    out = ""
    for k, c in enumerate(word):
        vowel = c in "aeiou" or c == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _form(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


_SECOND = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOURTH = "ement ment ent able ible ance ence ant ism ate iti ous ive ize ion al er ic ou".split()


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    more = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, more = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, more = w[:-3], True
    if more:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _doubled(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_SECOND, _THIRD):
        for a, b in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(a):
                if _measure(w[: -len(a)]) > 0:
                    w = w[: -len(a)] + b
                break
    for a in sorted(_FOURTH, key=len, reverse=True):
        if w.endswith(a):
            s = w[: -len(a)]
            if _measure(s) > 1 and (a != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_table(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"term": f[column], "stem": [stem(x) for x in f[column]]})

    return terms.select(F.col(column)).where(F.col(column).isNotNull()).distinct().mapInPandas(run, "term string, stem string")
