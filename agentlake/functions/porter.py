"""Porter's algorithm for suffix stripping (1980), for English words of ASCII letters."""

from __future__ import annotations

import functools
import re

_C, _V = "[^aeiou]", "[aeiouy]"
_CONS, _VOW = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_M0 = re.compile(f"^({_CONS})?{_VOW}{_CONS}")
_M1 = re.compile(f"^({_CONS})?{_VOW}{_CONS}({_VOW})?$")
_M2 = re.compile(f"^({_CONS})?{_VOW}{_CONS}{_VOW}{_CONS}")
_HAS_VOWEL = re.compile(f"^({_CONS})?{_V}")
_SHORT = re.compile(f"^{_CONS}{_V}[^aeiouwxy]$")
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split(" "))
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _longest(word: str, endings: object) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _M0.match(word[:-3]):
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending) and _HAS_VOWEL.match(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiouylsz":
                    word = word[:-1]
                elif _SHORT.match(word):
                    word += "e"
                break
    if word.endswith("y") and _HAS_VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (e := _longest(word, table)) and _M0.match(word[: -len(e)]):
            word = word[: -len(e)] + table[e]
    e = _longest(word, [*_STEP4, "ion"])
    if e and _M2.match(word[: -len(e)]) and (e != "ion" or word[-4] in "st"):
        word = word[: -len(e)]
    if word.endswith("e") and (_M2.match(word[:-1]) or (_M1.match(word[:-1]) and not _SHORT.match(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _M2.match(word):
        word = word[:-1]
    return word
