"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for lists of distinct words."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL = "[aeiou]|(?<=[^aeiou])y"
#: Suffix tables of steps 2 to 4 of the paper.
STEP2 = """ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize
ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble""".split()
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", re.sub("v+", "v", _shape(word))))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            start = word[: -len(suffix)]
            return start + table[suffix] if _measure(start) > least else word
    return word


def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if "v" in _shape(word[: -len(suffix)]):
                    word = word[: -len(suffix)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, dict(zip(STEP2[::2], STEP2[1::2])), 0)
    word = _longest(word, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            start = word[: -len(suffix)]
            if _measure(start) > 1 and (suffix != "ion" or start.endswith(("s", "t"))):
                word = start
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def kept_of(n: int) -> int:
    """How many of the first n letters of a stem are the word's own: a step takes letters off the end, and puts two others
    there at most (biliti, ble); the first letter always stays."""
    return min(n, max(1, n - 2))


@lru_cache(maxsize=1 << 17)
def remembered_stem(word: str) -> str:
    """stem(), for words that come again and again."""
    return stem(word)
