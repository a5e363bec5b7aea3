"""Porter's stemmer, run over a vocabulary rather than over tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_C = "(?:[^aeiouy]|(?<![^aeiou])y|^y)"
STEP2 = dict(p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
STEP3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(s: str) -> str:
    """Letters as c (consonant) or v (vowel)."""
    out = ""
    for i, ch in enumerate(s):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _shape(s)))


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


def _cvc(s: str) -> bool:
    return _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


def porter(w: str) -> str:
    """The stem of a lower-case word of three letters or more."""
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """porter: and the stem of words of 3 to 32 ASCII letters; other words as they are."""
    return "porter:" + porter(word.lower()) if re.fullmatch("[A-Za-z]{3,32}", word) else word


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stem_vocabulary(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of every distinct word: stemming sees each word once, however often it occurs."""
    every = words.select(word).distinct()
    stemmed = F.length(word).between(3, 32) & F.col(word).rlike("^[A-Za-z]+$")  # others don't go to Python
    return every.where(stemmed).select(word, _stem(word).alias("stem")).unionByName(every.where(~stemmed).select(word, F.col(word).alias("stem")))
