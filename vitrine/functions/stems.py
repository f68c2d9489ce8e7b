"""Terms for text search: letters and digits without diacritics, and English stems (Porter 1980)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes of steps 2, 3 and 4 (longest first where one ends in another).
STEP2 = dict(pair.split(":") for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP3 = dict(pair.split(":") for pair in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _form(word: str) -> str:
    """The word with v and c for vowels and consonants; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The Porter stem of a lower-case word; words of one or two letters, and words with other than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _form(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _form(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _m(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(word, table)
        if s and _m(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _longest(word, STEP4)
    if s and _m(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e") and (_m(word[:-1]) > 1 or (_m(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _m(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stemmed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of single terms; meant for the different terms of an index, not for running text."""
    for s in words:
        yield s.map(lambda w: stem(w) if isinstance(w, str) else None)


#: Latin letters with marks, and what is left without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőŕřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorrsstuuuzzz"


def terms(text: Column) -> Column:
    """The lower-case runs of letters and digits of a text, marks on Latin letters taken off, in order."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


_ascii, _any, _marks = re.compile("[a-z0-9]+").findall, regex.compile(r"[\p{L}\p{N}]+").findall, regex.compile(r"\p{Mn}+")
_cached_stem = lru_cache(200_000)(stem)


def terms_of(text: str | None, stems: bool = False) -> list[str]:
    """The lower-case runs of letters and digits of one text in order, without marks (canonical decomposition, then nonspacing marks go);
    ``stems``: their English stems. For tasks that index whole documents."""
    if not text:
        return []
    low = text.lower()
    own = _ascii(low) if low.isascii() else _any(_marks.sub("", unicodedata.normalize("NFD", low)))
    return [*map(_cached_stem, own)] if stems else own


def clean_query(text: Column) -> Column:
    """A search text without the signs of the query language, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[":*^(){}\[\]\\]', " "), r"\s+", " "))
