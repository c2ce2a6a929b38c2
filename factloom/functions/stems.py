"""Stems of single words, for vocabularies that a task meets: the same rules as stems() and porter() of text.py, which tests hold equal."""

from __future__ import annotations

import re

from .text import HAS_VOWEL, ONE, OVER_0, OVER_1, PORTER_2, PORTER_3, PORTER_4, SHORT

_DIGITS, _DOUBLE = re.compile("^[0-9]+$"), re.compile(r"([^aeiou])\1$")
_HAS_VOWEL, _OVER_0, _ONE, _OVER_1, _SHORT = map(re.compile, (HAS_VOWEL, OVER_0, ONE, OVER_1, SHORT))


def _longest(by: dict[str, str]) -> list[tuple[str, str]]:
    return [(s, by[s]) for s in sorted(by, key=len, reverse=True)]


_STEPS = ((_longest(PORTER_2), _OVER_0), (_longest(PORTER_3), _OVER_0), (_longest(dict.fromkeys(PORTER_4, "")), _OVER_1))


def depluralise(w: str) -> str:
    n = len(w)
    if w.endswith("ies") and n >= 6:
        return w[:-3] + "y"
    if w.endswith(("ses", "shes", "ches", "xes", "zes")) and n >= 5:
        return w[:-2]
    if w.endswith(("ss", "us", "is")):
        return w
    return w[:-1] if w.endswith("es") and n >= 5 or w.endswith("s") and n >= 4 else w


def stem(w: str) -> str:
    """The index's stem of one word; short words and digits stay."""
    n = len(w)
    if n <= 3 or _DIGITS.search(w):
        return w
    s = depluralise(w)
    if s == w:
        s = w[:-3] if w.endswith("ing") and n >= 6 else w[:-2] if w.endswith("ed") and n >= 5 else w
    return s[:-1] if len(s) > 3 and s.endswith("e") else s


def _bare(w: str) -> str:
    """A word that has lost -ed or -ing."""
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _DOUBLE.search(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _SHORT.search(w) else w


def porter(w: str) -> str:
    """The Porter stem of a lower-case word; words of one or two letters stay."""
    if len(w) <= 2:
        return w
    if w[0] == "y":
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _OVER_0.search(w[:-3]) else w
    elif w.endswith("ed") and _HAS_VOWEL.search(w[:-2]):
        w = _bare(w[:-2])
    elif w.endswith("ing") and _HAS_VOWEL.search(w[:-3]):
        w = _bare(w[:-3])
    if w.endswith("y") and _HAS_VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for suffixes, measure in _STEPS:
        for suffix, to in suffixes:
            if w.endswith(suffix):  # the longest one that fits decides
                left = w[: len(w) - len(suffix)]
                if measure.search(left) and (suffix != "ion" or left.endswith(("s", "t"))):
                    w = left + to
                break
    if w.endswith("e") and (_OVER_1.search(w[:-1]) or _ONE.search(w[:-1]) and not _SHORT.search(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _OVER_1.search(w):
        w = w[:-1]
    return w.lower()
