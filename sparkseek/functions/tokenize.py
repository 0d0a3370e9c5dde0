"""Tokenizers, as Python kernels with positions and as native column expressions for the default one."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, Analyzer
from .normalize import normalize, normalize_with_offsets, parse_call, raw, split_chain
from .stem import stem

#: Scripts written without spaces, cut into overlapping pairs.
_PAIRED = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_JAVA_TOKEN = f"[{_PAIRED}]{{1,2}}|[\\p{{L}}\\p{{M}}&&[^{_PAIRED}]]+|\\p{{N}}+|[^\\p{{L}}\\p{{M}}\\p{{N}}\\s\\x01]+"
_JAVA_RUN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s\x01]+"
_BREAK = "\x01"


def tokens_column(col: Column, analyzer: Analyzer = FULL_TEXT) -> Column:
    """array<string> of tokens in order, by native functions: runs of letters, digits and signs, and pairs of unspaced scripts."""
    text = normalize(col, analyzer.normalizer, analyzer.substitutions)
    name, args = parse_call(analyzer.tokenizer)
    if name in ("none", ""):
        return F.when(text.isNotNull(), F.array(text))
    if name == "TokenDelimit" and not args and not analyzer.token_filters:
        return F.filter(F.split(text, " "), lambda x: x != "")
    if name not in ("TokenBigram", "TokenNgram") or args or analyzer.token_filters:
        return F.transform(tokenize_column(col, analyzer), lambda t: t["value"])
    if raw(analyzer.normalizer):  # nothing is folded, and nothing is known of kinds of characters: all pairs
        return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(2))), lambda x: x != "")
    paired = F.regexp_replace(text, f"([{_PAIRED}])(?=([{_PAIRED}]))", f"$1$2{_BREAK}")
    pairs = F.regexp_extract_all(paired, F.lit(_JAVA_TOKEN), F.lit(0))
    # texts without unspaced scripts need neither the pairs nor a pattern that tells them apart
    return F.when(F.regexp_like(text, F.lit(f"[{_PAIRED}]")), pairs).otherwise(F.regexp_extract_all(text, F.lit(_JAVA_RUN), F.lit(0)))


def _kind(c: str) -> str:
    if re.match(f"[{_PAIRED}]", c):
        return "pair"
    if c.isspace():
        return "space"
    category = unicodedata.category(c)[0]
    return {"L": "letter", "M": "letter", "N": "digit"}.get(category, "sign")


def _grams(start: int, end: int, n: int) -> Iterator[tuple[int, int]]:
    for i in range(start, end):
        yield i, min(i + n, end)


def _spans(text: str, name: str, args: list, folded: bool) -> Iterator[tuple[int, int]]:
    options = dict(zip(args[::2], args[1::2]))
    if name in ("none", ""):
        if text:
            yield 0, len(text)
    elif name == "TokenDelimit":
        pattern = options.get("pattern")
        marks = [d for d in ([options["delimiter"]] if "delimiter" in options else [a for a in args if isinstance(a, str) and a not in ("delimiter",)]) or [" "]]
        at = 0
        for m in re.finditer(pattern or "|".join(map(re.escape, marks)), text):
            if m.start() > at:
                yield at, m.start()
            at = m.end()
        if at < len(text):
            yield at, len(text)
    elif name in ("TokenDelimitNull",):
        at = 0
        for part in text.split("\0"):
            if part:
                yield at, at + len(part)
            at += len(part) + 1
    else:
        n = {"TokenUnigram": 1, "TokenBigram": 2, "TokenTrigram": 3}.get(re.sub("(Split|Ignore).*", "", name), options.get("n", 2))
        split = {k for k in ("letter", "digit", "sign") if not folded or options.get({"letter": "unify_alphabet", "digit": "unify_digit", "sign": "unify_symbol"}[k]) is False}
        if "SplitSymbol" in name:
            split.add("sign")
        if "Alpha" in name:
            split.add("letter")
        if "Digit" in name:
            split.add("digit")
        if name == "TokenRegexp":
            yield from _grams(0, len(text), 2)
            return
        if not folded:
            yield from _grams(0, len(text), n)
            return
        i = 0
        while i < len(text):
            k, j = _kind(text[i]), i
            while j < len(text) and (kind := _kind(text[j])) == k:
                j += 1
            if k == "space":
                pass
            elif k == "pair" or k in split:
                yield from _grams(i, j, n)
            else:
                yield i, j
            i = j


_NAMES = re.compile("Token(Bigram|Unigram|Trigram)(IgnoreBlank)?(Split(Symbol(Alpha(Digit)?)?)?)?|TokenNgram|TokenDelimit|TokenDelimitNull|TokenRegexp|none|")


@dataclass(frozen=True)
class Token:
    """value; position among the tokens; [start, end) in characters of the original text, and where blanks before it begin; whether
    it is a pair, or longer gram, cut short by the end of its run."""

    value: str
    position: int
    start: int
    end: int
    blank: int
    short: bool = False


def tokens_of(text: str, analyzer: Analyzer = FULL_TEXT) -> list[Token]:
    name, args = parse_call(analyzer.tokenizer)
    if not _NAMES.fullmatch(name):
        raise ValueError(f"unknown tokenizer: {name}")
    options = dict(zip(args[::2], args[1::2]))
    folded, back = normalize_with_offsets(text, analyzer.normalizer, analyzer.substitutions)
    if options.get("loose_symbol") or options.get("loose_blank"):
        loose = {k for k, o in (("sign", "loose_symbol"), ("space", "loose_blank")) if options.get(o)}
        keep = [i for i, c in enumerate(folded) if _kind(c) not in loose]
        folded, back = "".join(folded[i] for i in keep), [back[i] for i in keep]
    out: list[Token] = []
    spans = list(_spans(folded, name, args, not raw(analyzer.normalizer)))
    for position, (a, b) in enumerate(spans):
        value = folded[a:b]
        for f in analyzer.token_filters:
            fname, fargs = parse_call(f)
            if fname == "TokenFilterStem":
                value = stem(value)
            elif fname.startswith("TokenFilterNFKC"):
                value = normalize_with_offsets(value, "NormalizerNFKC" + f.strip()[len("TokenFilterNFKC") :])[0]
            elif fname == "TokenFilterStopWord":
                value = "" if value in fargs else value
            elif fname not in ("", "none"):
                raise ValueError(f"unknown token filter: {fname}")
        if value:
            start, end = back[a], back[b - 1] + 1
            while end < len(text) and (unicodedata.combining(text[end]) or text[end] in "ﾞﾟ"):  # marks that fold into the last character
                end += 1
            blank = start
            while blank and text[blank - 1].isspace():
                blank -= 1
            before = spans[position - 1] if position else (0, 0)
            out.append(Token(value, len(out), start, end, blank, before[1] > a and before[1] == b))
    return out


def located(analyzer: Analyzer) -> bool:
    """Whether the tokenizer reports where in the original its tokens stand."""
    _, args = parse_call(analyzer.tokenizer)
    return bool(dict(zip(args[::2], args[1::2])).get("report_source_location"))


def tokenize(text: str, analyzer: Analyzer = FULL_TEXT) -> list[dict]:
    """Tokens of one text: value, position, whether it is not the first, and, where the tokenizer reports it, its place in the
    original in bytes. Blanks before a token belong to it there, as in the tokenizer's own report."""
    report, out, at = located(analyzer), [], [0]
    if report:
        for c in text:
            at.append(at[-1] + len(c.encode()))
    for t in tokens_of(text, analyzer):
        token = {"value": t.value, "position": t.position, "force_prefix_search": t.position != 0, "source_offset": None, "source_length": None, "source_first_character_length": None}
        if report:
            token |= {"source_offset": at[t.blank], "source_length": at[t.end] - at[t.blank], "source_first_character_length": at[t.start + 1] - at[t.blank]}
        out.append(token)
    return out


def analyzer_of(options: dict[str, str | bool], column: str | None = None, use: str = "full_text_search", base: Analyzer | None = None) -> Analyzer:
    """The analyzer that index options describe for a column. use: full_text_search, regexp_search, prefix_search or term_search.

    Options: tokenizer, tokenizer_mapping, normalizer, normalizers, normalizers_mapping, <use>_normalizer, token_filters,
    lexicon_type, query_allow_column; mappings are JSON from column to value and win. plugins and flags of storage change no
    result and are passed over; a name that is none of these is an error.
    """
    known = {"tokenizer", "tokenizer_mapping", "normalizer", "normalizers", "normalizers_mapping", "full_text_search_normalizer", "regexp_search_normalizer", "prefix_search_normalizer", "token_filters", "plugins", "lexicon_type", "query_allow_column", "index_flags_mapping", "lexicon_flags_mapping", "model", "n_gpu_layers", "passage_prefix", "query_prefix"}
    if unknown := sorted(set(options) - known):
        raise ValueError(f"unknown option: {unknown[0]}")

    def pick(single: tuple[str, ...], mapping: str, default: str | None) -> str | None:
        of = json.loads(str(options.get(mapping) or "{}"))
        if column in of:
            return of[column]
        return next((str(options[k]) for k in single if k in options), default)

    default = base or (FULL_TEXT if use == "full_text_search" else Analyzer(tokenizer="TokenRegexp") if use == "regexp_search" else Analyzer(tokenizer="none"))
    tokenizer = pick(("tokenizer",), "tokenizer_mapping", default.tokenizer) if use == "full_text_search" else default.tokenizer
    normalizer = pick((f"{use}_normalizer", "normalizers", "normalizer"), "normalizers_mapping", default.normalizer)
    if normalizer in ("NormalizerAuto",):
        normalizer = "auto"
    filters = tuple(f for f in split_chain(str(options.get("token_filters") or "")) if f != "none")
    allow = options.get("query_allow_column", False) in (True, "true", "on", "1")
    return Analyzer(None if raw(normalizer) else normalizer, tokenizer or "none", filters, allow, options.get("lexicon_type") != "hash_table", default.substitutions)


def tokenize_with(text: str, *options: str) -> list[dict]:
    """Tokens of a text with options given as names and values in turn: tokenizer, normalizer, normalizers, token_filters."""
    given: dict[str, str] = {}
    for i in range(0, len(options), 2):
        if options[i] not in ("tokenizer", "normalizer", "normalizers", "token_filters"):
            raise ValueError(f"unknown parameter name: <{options[i]}>")
        if i + 1 == len(options):
            raise ValueError(f"parameter value is missing: <{options[i]}>")
        given[options[i]] = options[i + 1]
    return tokenize(text, analyzer_of(given, base=Analyzer(normalizer=None)))


SCHEMA = "array<struct<value:string,position:int,force_prefix_search:boolean,source_offset:int,source_length:int,source_first_character_length:int>>"


def tokenize_column(col: Column, analyzer: Analyzer = FULL_TEXT) -> Column:
    """Tokens with positions and source offsets, by Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else tokenize(t, analyzer))

    return run(col)


@lru_cache(maxsize=4096)
def query_terms(text: str, analyzer: Analyzer = FULL_TEXT) -> tuple[tuple[int, str, bool], ...]:
    """(place, token, whether it is a prefix) of a query term.

    A gram cut short by the end of its run says nothing that the grams before it do not, and is left out; a run shorter than a
    gram stands for all grams that begin with it.
    """
    name, args = parse_call(analyzer.tokenizer)
    n = 0 if name in ("none", "", "TokenDelimit", "TokenDelimitNull") else {"TokenUnigram": 1, "TokenTrigram": 3}.get(re.sub("(Split|Ignore).*", "", name), dict(zip(args[::2], args[1::2])).get("n", 2))
    out = []
    for t in tokens_of(text, analyzer):
        if t.short:
            continue
        gram = bool(n) and len(t.value) < n and (raw(analyzer.normalizer) or name == "TokenRegexp" or _kind(t.value[0]) == "pair")
        out.append((t.position, t.value, gram))
    return tuple(out)


def query_tokens(text: str, analyzer: Analyzer = FULL_TEXT) -> tuple[str, ...]:
    """Token values of a query term."""
    return tuple(t for _, t, _ in query_terms(text, analyzer))
