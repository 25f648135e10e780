"""Porter stemming (M. F. Porter, 1980) with the usual small extensions, as an Arrow function.

Only distinct words of a batch are stemmed, and each worker remembers what it has seen; the text
itself stays partitioned by Spark.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published suffix rules of the algorithm, in the order in which they are tried.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
MIN_STEMMED_LENGTH = 4

_MEASURE = re.compile(r"[aeiouY]+[^aeiouY]+")
_VOWEL = re.compile(r"[aeiouY]")
_CVC_END = re.compile(r"(?:[^aeiouY][aeiouY]|^[aeiouY])[^aeiouY]$")


def _shape(word: str) -> str:
    """The word with every vowel-like ``y`` (one that follows a consonant) written as ``Y``."""
    out: list[str] = []
    for ch in word:
        out.append("Y" if ch == "y" and out and out[-1] not in "aeiouY" else ch)
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return bool(_VOWEL.search(_shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends consonant-vowel-consonant with a last letter other than w, x, y."""
    shape = _shape(stem)
    if len(shape) == 2:
        return bool(_CVC_END.search(shape))
    return len(shape) > 2 and bool(_CVC_END.search(shape)) and shape[-1] not in "wxy"


def _double_consonant(word: str) -> bool:
    shape = _shape(word)
    return len(shape) > 1 and word[-1] == word[-2] and shape[-1] not in "aeiouY"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
            stem = w[: -len(suffix)]
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _final_y(w: str) -> str:
    stem = w[:-1]
    consonant = len(stem) > 1 and _shape(stem)[-1] not in "aeiouY"
    return stem + "i" if w.endswith("y") and consonant else w


def _replace(w: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The first matching suffix decides; it is replaced if the stem has a measure above 0."""
    for suffix, new in rules:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else w
    return w


def _double_suffix(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _double_suffix(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _replace(w, STEP_2)


def _drop_suffix(w: str) -> str:
    for suffix in STEP_4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            allowed = _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st")
            return stem if allowed else w
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            return w[:-1]
    return w


def _final_double_l(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    if len(word) < MIN_STEMMED_LENGTH:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = _final_y(_past(_plural(word)))
    w = _drop_suffix(_replace(_double_suffix(w), STEP_3))
    return _final_double_l(_final_e(w))


@F.pandas_udf(T.StringType())
def stem_text(texts: pd.Series) -> pd.Series:
    """Lower-case texts of space-separated words -> the stemmed words, in the same order."""
    return texts.map(lambda t: " ".join(map(stem_word, t.split(" "))), na_action="ignore")
