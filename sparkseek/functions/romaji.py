"""Kana to romaji, and prefix tests of romaji or kana input against katakana readings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ"}
_TABLE: dict[str, tuple[str, ...]] = {k: (c + v,) for c, row in _ROWS.items() for k, v in zip(row, "aiueo")}
_TABLE |= {"ヤ": ("ya",), "ユ": ("yu",), "ヨ": ("yo",), "ワ": ("wa",), "ヲ": ("wo", "o"), "ン": ("n", "nn", "n'"), "ヴ": ("vu",), "ー": ("-",), "ッ": ("xtu", "ltu")}
_TABLE |= {"シ": ("si", "shi"), "チ": ("ti", "chi"), "ツ": ("tu", "tsu"), "フ": ("hu", "fu"), "ジ": ("zi", "ji"), "ヂ": ("di",), "ヅ": ("du",)}
_TABLE |= {k: ("x" + v, "l" + v) for k, v in zip("ァィゥェォャュョヮ", ("a", "i", "u", "e", "o", "ya", "yu", "yo", "wa"))}
for _head, _stems in {"キ": ("ky",), "ギ": ("gy",), "ニ": ("ny",), "ヒ": ("hy",), "ミ": ("my",), "リ": ("ry",), "ビ": ("by",), "ピ": ("py",), "シ": ("sy", "sh"), "チ": ("ty", "ch"), "ジ": ("zy", "j", "jy")}.items():
    for _small, _vowel in zip("ャュョ", "auo"):
        _TABLE[_head + _small] = tuple(s + _vowel for s in _stems)
for _head, _stem in {"フ": "f", "ヴ": "v", "テ": "th", "デ": "dh", "ウ": "w"}.items():
    for _small, _vowel in zip("ァィェォ", "aieo"):
        _TABLE.setdefault(_head + _small, (_stem + _vowel,))


def katakana(text: str) -> str:
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)


def to_romaji(text: str) -> str:
    """One romaji spelling of kana; other characters stay."""
    text, out, i = katakana(text), [], 0
    while i < len(text):
        for n in (2, 1):
            if text[i : i + n] in _TABLE and len(text[i : i + n]) == n:
                out.append(_TABLE[text[i : i + n]][0])
                i += n
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


@lru_cache(maxsize=4096)
def reads_as(reading: str, start: str) -> bool:
    """Whether a katakana reading begins with the input: romaji letter by letter, kana, or a mixture."""
    reading, start = katakana(reading), katakana(start.lower())

    def walk(i: int, rest: str) -> bool:
        if not rest:
            return True
        if i >= len(reading):
            return False
        if reading[i] == rest[0] and walk(i + 1, rest[1:]):
            return True
        if reading[i] == "ッ" and i + 1 < len(reading) and len(rest) and rest[0].isalpha():  # a doubled consonant
            if len(rest) == 1 and any(s.startswith(rest) for s in _TABLE.get(reading[i + 1], ())):
                return True
            if len(rest) > 1 and rest[0] == rest[1] and walk(i + 1, rest[1:]):
                return True
        for n in (2, 1):
            for s in _TABLE.get(reading[i : i + n], ()) if len(reading[i : i + n]) == n else ():
                if s.startswith(rest) or rest.startswith(s) and walk(i + n, rest[len(s) :]):
                    return True
        return False

    return bool(start) and walk(0, start)


def reads_as_any(col: Column, starts: list[str]) -> Column:
    """Column form over a text column, by Arrow batches."""
    wanted = [s for s in starts if s]

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else any(reads_as(t, w) for w in wanted))

    return run(col)


def reads_as_any_element(col: Column, starts: list[str]) -> Column:
    """Column form over an array column: some element's reading begins with some input; elements that are null are passed over."""
    wanted = [s for s in starts if s]

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: v is not None and any(x is not None and reads_as(x, w) for x in v for w in wanted))

    return run(col)
