"""Normalisation: width, case and the options of named normalizers, with a map back to the original text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_to_one() -> tuple[str, str]:
    """Characters of the basic plane that compatibility folding turns into one other character."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            n = unicodedata.normalize("NFKC", c)
            if len(n) == 1 and n != c and not unicodedata.combining(c):
                source.append(c)
                target.append(n)
    return "".join(source), "".join(target)


_FROM, _TO = _one_to_one()


def parse_call(text: str) -> tuple[str, list]:
    """'Name("a", true, 3)' to its name and arguments."""
    m = re.fullmatch(r"\s*(\w*)\s*(?:\((.*)\))?\s*", text, re.S)
    if not m:
        raise ValueError(f"not a name with arguments: {text!r}")
    args = []
    for quoted, single, bare in re.findall(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([^\s,()]+)", m[2] or ""):
        value = re.sub(r"\\(.)", r"\1", quoted or single)
        args.append({"true": True, "false": False}.get(bare, int(bare) if re.fullmatch(r"-?\d+", bare) else bare) if bare else value)
    return m[1], args


def split_chain(text: str) -> list[str]:
    """Calls parted by commas that are outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in (*out, text[start:]) if x.strip()]


def raw(spec: str | None) -> bool:
    """Whether a normalizer leaves texts as they are."""
    return spec in (None, "", "none")


def _options(args: list) -> dict:
    return dict(zip(args[::2], args[1::2]))


_MIDDLE_DOTS = "·ᐧ•∙⋅⸱・･"
_HYPHENS = "-˗֊‐‑‒–—⁃⁻₋−"
_PROLONGED = "ー—―─━ｰ"


def _kana(c: str) -> str:
    return chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c


@lru_cache(maxsize=256)
def _rules(spec: str) -> tuple[dict, ...]:
    return tuple({"name": n, **_options(a)} for n, a in map(parse_call, split_chain(spec)))


#: Characters that folding leaves alone but for their case, one to one; as a pattern of Python and of Java.
PLAIN = r"[\t\n\r\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u2013\u2014\u2018-\u201E]*"
_plain = re.compile(PLAIN)


def _folded(text: str) -> tuple[str, list[int] | range]:
    """Width and case folded, with the index each character comes from; runs of plain characters are taken at once."""
    n = len(text)
    if _plain.fullmatch(text):
        return text.lower(), range(n)
    marks = lambda j: j < n and (unicodedata.combining(text[j]) or text[j] in "ﾞﾟ")
    out, back, i = [], [], 0
    while i < n:
        j = _plain.match(text, i).end()
        if j > i and marks(j):
            j -= 1
        if j > i:
            out.append(text[i:j].lower())
            back += range(i, j)
            i = j
            continue
        j = i + 1
        while marks(j):
            j += 1
        for x in unicodedata.normalize("NFKC", text[i:j]):
            x = x.lower()
            out.append(x)
            back += [i] * len(x)
        i = j
    return "".join(out), back


def normalize_with_offsets(text: str, spec: str | None = "auto", substitutions: tuple = ()) -> tuple[str, list[int]]:
    """Normalised text, and for each of its characters the index of the original character it comes from.

    A base character and the marks that compose with it count as coming from the base.
    """
    for target, by in substitutions:
        text = text.replace(target, by)
    if raw(spec):
        return text, list(range(len(text)))
    if spec == "lower":
        pairs = [(x, i) for i, c in enumerate(text) for x in c.lower()]
        return "".join(x for x, _ in pairs), [i for _, i in pairs]
    if spec == "auto":
        return _folded(text)
    rules = _rules(spec)
    pairs: list[tuple[str, int]] = []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or text[j] in "ﾞﾟ"):
            j += 1
        pairs += [(x, i) for x in unicodedata.normalize("NFKC", text[i:j])]
        i = j
    for r in rules:
        if r["name"] and not r["name"].startswith("Normalizer"):
            raise ValueError(f"unknown normalizer: {r['name']}")
        pairs = [(x, i) for c, i in pairs for x in c.lower()]
        if r.get("unify_kana"):
            pairs = [(_kana(c), i) for c, i in pairs]
        if r.get("unify_hyphen"):
            pairs = [("-" if c in _HYPHENS else c, i) for c, i in pairs]
        if r.get("unify_prolonged_sound_mark"):
            pairs = [("ー" if c in _PROLONGED else c, i) for c, i in pairs]
        if r.get("unify_hyphen_and_prolonged_sound_mark"):
            pairs = [("-" if c in _HYPHENS or c in _PROLONGED else c, i) for c, i in pairs]
        if r.get("unify_middle_dot"):
            pairs = [("·" if c in _MIDDLE_DOTS else c, i) for c, i in pairs]
        if r.get("unify_kana_case"):
            small = dict(zip("ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ", "あいうえおつやゆよわアイウエオツヤユヨワカケ"))
            pairs = [(small.get(c, c), i) for c, i in pairs]
        if r.get("unify_kana_voiced_sound_mark"):
            pairs = [(unicodedata.normalize("NFD", c)[0] if "ぁ" <= c <= "ヿ" else c, i) for c, i in pairs]
        if r.get("unify_latin_alphabet_with") or r.get("unify_diacritical_mark"):
            pairs = [(unicodedata.normalize("NFD", c)[0] if c.isalpha() and ord(c) < 0x250 else c, i) for c, i in pairs]
        if r.get("unify_to_romaji"):
            from .romaji import to_romaji

            out = []
            for c, i in pairs:
                out += [(x, i) for x in (to_romaji(c) or c)]
            pairs = out
        if r.get("unify_to_katakana"):
            pairs = [(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c, i) for c, i in pairs]
        if r.get("remove_symbol"):
            pairs = [(c, i) for c, i in pairs if not unicodedata.category(c)[0] in "PS"]
        if r.get("remove_blank") or r.get("remove_new_line"):
            pairs = [(c, i) for c, i in pairs if not (c.isspace() if r.get("remove_blank") else c in "\r\n")]
    return "".join(c for c, _ in pairs), [i for _, i in pairs]


class _Each(dict):
    """What a named normalizer makes of a character, by its code, found when one is first met."""

    def __init__(self, spec: str):
        self.spec = spec
        normalize_with_offsets("", spec)  # an unknown name is an error, whatever the texts are

    def __missing__(self, code: int) -> str:
        self[code] = made = normalize_with_offsets(chr(code), self.spec)[0]
        return made


@lru_cache(maxsize=64)
def _each(spec: str) -> _Each:
    return _Each(spec)


@lru_cache(maxsize=1)
def _marks() -> tuple[re.Pattern, re.Pattern]:
    """Marks that compose with the character before them, and such a character with its marks."""
    some = "".join(c for c in map(chr, range(0x300, 0x110000)) if unicodedata.combining(c)) + "ﾞﾟ"
    return re.compile(f"[{some}]"), re.compile(f"(.[{some}]+)", re.S)


def normalize_text(text: str | None, spec: str | None = "auto", substitutions: tuple = ()) -> str | None:
    if text is None:
        return None
    if raw(spec) or spec in ("lower", "auto"):
        return normalize_with_offsets(text, spec, substitutions)[0]
    for target, by in substitutions:
        text = text.replace(target, by)
    # rules of named normalizers see one character, with its marks, at a time
    each, (mark, marked) = _each(spec), _marks()
    if text.isascii() or not mark.search(text):
        return text.translate(each)
    parts = marked.split(text)
    return "".join(normalize_with_offsets(x, spec)[0] if i % 2 else x.translate(each) for i, x in enumerate(parts))


def _folds_alone(spec: str) -> bool:
    """Whether a named normalizer has no option that is on, so that plain characters change in their case alone."""
    rules = _rules(spec)
    return bool(rules) and all((not r["name"] or r["name"].startswith("Normalizer")) and not any(on for k, on in r.items() if k != "name") for r in rules)


_one_by_one = str.maketrans(_FROM, _TO)


def normalize_plain(text: str) -> str:
    """What the native form of 'auto' makes of a text: compatibility characters that stand for one other, and case."""
    return text.translate(_one_by_one).lower()


def normalize(col: Column, spec: str | None = "auto", substitutions: tuple = ()) -> Column:
    """A column normalised. 'auto', 'lower' and None stay native, as do plain texts under a named normalizer without options; other
    texts of named normalizers run by Arrow batches."""
    for target, by in substitutions:
        col = F.replace(col, F.lit(target), F.lit(by))
    if raw(spec):
        return col
    if spec == "lower":
        return F.lower(col)
    if spec == "auto":
        # plain ASCII, which is as many bytes as characters, has nothing to fold but its case
        return F.lower(F.when(F.length(col) == F.octet_length(col), col).otherwise(F.translate(col, _FROM, _TO)))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: normalize_text(t, spec))

    if _folds_alone(spec):
        return F.coalesce(run(F.when(~F.regexp_like(col, F.lit(rf"\A{PLAIN}\z")), col)), F.lower(col))
    return run(col)


def normalize_elements(col: Column, spec: str | None = "auto") -> Column:
    """An array column, its elements normalised by native functions."""
    return F.transform(col, lambda x: normalize(x, spec if raw(spec) or spec in ("lower", "auto") else "auto"))
