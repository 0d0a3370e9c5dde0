"""English stems: the suffix steps of Porter's algorithm (1980)."""

from __future__ import annotations

import re

_V, _C = "[aeiouy]", "[^aeiou]"
_M = re.compile(r"(?:[aeiouy]+[^aeiouy]+)")
_LONG = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_MORE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _measure(s: str) -> int:
    return len(_M.findall(re.sub("^[^aeiouy]+", "", s)))


def _cvc(s: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", s))


def stem(w: str) -> str:
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and re.search(_V, w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and re.search(_V, w[:-1]):
        w = w[:-1] + "i"
    for table in (_LONG, _MORE):
        for a, b in table:
            if w.endswith(a):
                if _measure(w[: -len(a)]) > 0:
                    w = w[: -len(a)] + b
                break
    for a in sorted(_LAST, key=len, reverse=True):
        if w.endswith(a):
            if _measure(w[: -len(a)]) > 1:
                w = w[: -len(a)]
            break
    else:
        if w.endswith(("sion", "tion")) and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
