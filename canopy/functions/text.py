"""Words for full-text search: Unicode word splitting, diacritics and Porter's stemmer (1980)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.scalar import strip_marks

#: A word is a run of letters and digits of any script.
WORD = r"[\p{L}\p{N}\p{Co}]+"
_VOWEL_RUN, _CONSONANT_RUN = "V", "C"

# Suffixes of the stemmer's steps and what replaces them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """The stem's letters as runs of vowels and consonants: 'trouble' is CVCV."""
    out = ""
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and i > 0 and not _is_vowel(stem, i - 1))
        kind = _VOWEL_RUN if vowel else _CONSONANT_RUN
        if not out.endswith(kind):
            out += kind
    return out


def _is_vowel(stem: str, i: int) -> bool:
    c = stem[i]
    return c in "aeiou" or (c == "y" and i > 0 and not _is_vowel(stem, i - 1))


def _measure(stem: str) -> int:
    return _shape(stem).count("VC")


def _has_vowel(stem: str) -> bool:
    return "V" in _shape(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _is_vowel(w, n - 1) and _is_vowel(w, n - 2) and not _is_vowel(w, n - 3) and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(100_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of other letters and of up to two stay."""
    if len(w) < 3 or len(w) > 20 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (s := _longest(w, ["ed", "ing"])) and _has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, STEP4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(lambda ws: None if ws is None else [stem(strip_marks(w)) for w in ws])


def words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms(text: Column, stemmed: bool = True) -> Column:
    """Index terms in order: words, without diacritics and stemmed unless told otherwise."""
    return _terms(words(text)) if stemmed else words(text)


def query_phrases(query: str, stemmed: bool = True) -> list[list[str]]:
    """Each blank-separated part of a query as the phrase of its terms; quotes are dropped."""
    import regex

    phrases = []
    for part in query.replace('"', " ").split():
        found = regex.findall(WORD, part.lower())
        if found:
            phrases.append([stem(strip_marks(w)) if stemmed else w for w in found])
    return phrases
