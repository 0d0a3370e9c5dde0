"""Predicates over text, text arrays and plain columns, as Column expressions evaluated on a scan.

Text matches are by normalised substring: `match(col, "spark")` holds for "PySpark" too. Matches of whole tokens and phrases, and
scores, are those of a token index (operators.index). NULL never matches and is never an error; empty terms match nothing.
Weights that are 0 leave a section out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, Analyzer
from ..functions.normalize import normalize, normalize_elements
from ..functions.romaji import reads_as_any, reads_as_any_element
from ..functions.tokenize import query_terms, tokens_column
from ..plans.query import Leaf, leaves, parse
from ..plans.scan import query_condition


@dataclass(frozen=True)
class Condition:
    """A query with its options. weights: one for each section, 0 leaves it out, None is 1; scorers likewise."""

    query: str | None = None
    weights: tuple | None = None
    scorers: tuple | None = None
    schema_name: str | None = None
    index_name: str | None = None
    column_name: str | None = None
    fuzzy_max_distance_ratio: float | None = None

    def column(self) -> Column:
        lit = F.lit
        return F.struct(
            lit(self.query).alias("query"), F.array(*map(lit, self.weights or ())).cast("array<int>").alias("weights"), F.array(*map(lit, self.scorers or ())).cast("array<string>").alias("scorers"),
            lit(self.schema_name).alias("schema_name"), lit(self.index_name).alias("index_name"), lit(self.column_name).alias("column_name"), lit(self.fuzzy_max_distance_ratio).alias("fuzzy_max_distance_ratio"),
        )


def _unpack(query) -> tuple[str | None, tuple | None]:
    return (query.query, query.weights) if isinstance(query, Condition) else (query, None)


def _off(weights: tuple | None, section: int = 0) -> bool:
    return bool(weights) and section < len(weights) and weights[section] == 0


def _never(col: Column) -> Column:
    return F.lit(False) & col.isNotNull()


def _any(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _term(term: str, a: Analyzer) -> Column:
    return normalize(F.lit(term), a.normalizer, a.substitutions) if a.normalizer in (None, "none", "lower", "auto") else F.lit(_kernel(term, a))


def _kernel(term: str, a: Analyzer) -> str:
    from ..functions.normalize import normalize_text

    return normalize_text(term, a.normalizer, a.substitutions)


def match(col: Column, term, a: Analyzer = FULL_TEXT) -> Column:
    """Normalised value contains the normalised term."""
    term, weights = _unpack(term)
    if not term or _off(weights):
        return _never(col)
    return _yes(normalize(col, a.normalizer, a.substitutions).contains(_term(term, a)))


def _in_array(col: Column, test: Callable[[Column], Column], weights: tuple | None, a: Analyzer) -> Column:
    """Some element passes; weights leave out elements by place, and elements beyond them are not searched."""
    values = normalize_elements(col, a.normalizer)
    if weights:
        values = F.array(*[F.get(values, F.lit(i)) for i, w in enumerate(weights) if w != 0])
    return _yes(F.exists(values, lambda x: _yes(test(x))))


def match_array(col: Column, term, a: Analyzer = FULL_TEXT) -> Column:
    term, weights = _unpack(term)
    return _never(col) if not term else _in_array(col, lambda x: x.contains(_term(term, a)), weights, a)


def match_any(col: Column, terms: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    return _any(match(col, t, a) for t in terms if t)


def match_array_any(col: Column, terms: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    return _any(match_array(col, t, a) for t in terms if t)


def query(col: Column, q, a: Analyzer = FULL_TEXT, others: dict[str, Column] | None = None, strict: bool = False) -> Column:
    """Query language over one text column. others: columns that a qualifier may name, if the analyzer allows qualifiers."""
    text, weights = _unpack(q)
    if not text or _off(weights):
        return _never(col)

    def leaf(value: Column, x: Leaf) -> Column:
        if x.column:
            return _qualified(x, others or {}, a)
        t = _term(x.text, a)
        if x.kind == "prefix":  # some word begins with it
            return _yes(F.exists(F.split(value, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w.startswith(t)))
        return _yes(value.contains(t))

    holds = lambda value: query_condition(text, lambda x: leaf(value, x), a.query_allow_column, strict)
    value, tree = normalize(col, a.normalizer, a.substitutions), parse(text, a.query_allow_column)
    if tree is None or len(leaves(tree)) < 2:
        return holds(value) & col.isNotNull()
    return _yes(F.exists(F.array(value), holds)) & col.isNotNull()  # an array of one value, so that it is normalised once


def _qualified(x: Leaf, others: dict[str, Column], a: Analyzer) -> Column:
    name, op = x.column.split(":", 1)
    if name not in others:
        return F.lit(False)
    c = others[name]
    if op == "@":
        return match(c.cast("string"), x.text, a)
    if op == "^":
        return prefix(c.cast("string"), x.text, a)
    if op == "~":
        return regexp(c.cast("string"), x.text, a)
    v = F.lit(x.text)
    return _yes({"=": c == v, "!": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op])


def query_array(col: Column, q, a: Analyzer = FULL_TEXT) -> Column:
    """Query language over an array: the terms may be in different elements."""
    text, weights = _unpack(q)
    if not text:
        return _never(col)

    def leaf(x: Leaf) -> Column:
        t = _term(x.text, a)
        if x.kind == "prefix":
            return _in_array(col, lambda v: F.exists(F.split(v, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w.startswith(t)), weights, a)
        return _in_array(col, lambda v: v.contains(t), weights, a)

    return query_condition(text, leaf) & col.isNotNull()


def query_tokens_of(col: Column, q, a: Analyzer = FULL_TEXT) -> Column:
    """Query language with the rule of a token index, on a scan: words and phrases match whole tokens of the analyzer."""
    text, weights = _unpack(q)
    if not text or not text.strip() or _off(weights):
        return _never(col)

    def leaf(tokens: Column, x: Leaf) -> Column:
        want = query_terms(x.text, a)
        if not want:
            return F.lit(False)
        same = lambda have, i: have.startswith(want[i][1]) if want[i][2] or x.kind == "prefix" and i == len(want) - 1 else have == want[i][1]
        if len(want) == 1:
            return _yes(F.exists(tokens, lambda t: same(t, 0)))
        # a phrase stands where its first token does and the others at their distances
        at = lambda i, k: F.coalesce(same(F.get(tokens, i + F.lit(want[k][0] - want[0][0])), k), F.lit(False))
        places = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)))
        return _yes(F.exists(places, lambda i: reduce(lambda x, y: x & y, [at(i, k) for k in range(len(want))])))

    # one array of one array of tokens, so that a row's tokens are made once
    holds = F.exists(F.array(tokens_column(col, a)), lambda tokens: query_condition(text, lambda x: leaf(tokens, x), a.query_allow_column))
    return _yes(holds) & col.isNotNull()


def query_any(col: Column, queries: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    return _any(query(col, q, a) for q in queries if q)


def query_array_any(col: Column, queries: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    return _any(query_array(col, q, a) for q in queries if q)


def prefix(col: Column, start, a: Analyzer = FULL_TEXT) -> Column:
    """The whole value begins with it, both normalised."""
    start, weights = _unpack(start)
    if not start or _off(weights):
        return _never(col)
    return _yes(normalize(col, a.normalizer).startswith(_term(start, a)))


def prefix_array(col: Column, start, a: Analyzer = FULL_TEXT) -> Column:
    start, weights = _unpack(start)
    return _never(col) if not start else _in_array(col, lambda x: x.startswith(_term(start, a)), weights, a)


def prefix_any(col: Column, starts: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    return _any(prefix(col, s, a) for s in starts if s)


def prefix_array_any(col: Column, starts: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    return _any(prefix_array(col, s, a) for s in starts if s)


def not_prefix_any(col: Column, starts: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    """No prefix of the list; null values do not match."""
    return ~prefix_any(col, starts, a) & col.isNotNull()


def prefix_romaji(col: Column, start: str | None) -> Column:
    """A katakana reading begins with romaji, hiragana or katakana."""
    return _never(col) if not start else _yes(reads_as_any(col, [start]))


def prefix_romaji_any(col: Column, starts: Iterable[str | None]) -> Column:
    wanted = [s for s in starts if s]
    return _yes(reads_as_any(col, wanted)) if wanted else _never(col)


def prefix_romaji_array(col: Column, start: str | None) -> Column:
    return prefix_romaji_array_any(col, [start])


def prefix_romaji_array_any(col: Column, starts: Iterable[str | None]) -> Column:
    wanted = [s for s in starts if s]
    if not wanted:
        return _never(col)

    return _yes(reads_as_any_element(col, wanted))


def equal(col: Column, other, a: Analyzer = FULL_TEXT) -> Column:
    """Normalised values are equal."""
    other, weights = _unpack(other)
    if not other or _off(weights):
        return _never(col)
    return _yes(normalize(col, a.normalizer) == _term(other, a))


def equal_query_array(col: Column, q, a: Analyzer = FULL_TEXT) -> Column:
    """Query language whose leaves are equalities with some element; prefixes stay prefixes."""
    text, weights = _unpack(q)
    if not text:
        return _never(col)

    def leaf(x: Leaf) -> Column:
        return _in_array(col, lambda v: v.startswith(_term(x.text, a)) if x.kind == "prefix" else v == _term(x.text, a), weights, a)

    return query_condition(text, leaf) & col.isNotNull()


def contains_element(col: Column, value: str) -> Column:
    return _yes(F.array_contains(col, value))


def contains_all(col: Column, values: list) -> Column:
    return _yes(F.size(F.array_except(F.array(*map(F.lit, values)), col)) == 0) if values else col.isNotNull()


def regexp(col: Column, pattern, a: Analyzer = FULL_TEXT) -> Column:
    """Pattern over the normalised value; \\A and \\z anchor the whole."""
    pattern, weights = _unpack(pattern)
    if not pattern or _off(weights):
        return _never(col)
    return _yes(F.regexp_like(normalize(col, a.normalizer), F.lit(translate_regexp(pattern))))


def translate_regexp(pattern: str) -> str:
    """Ruby forms that Java spells otherwise."""
    return pattern.replace(r"\h", "[0-9a-fA-F]").replace("(?<!\\\\)\\Z", "\\Z")


def regexp_array(col: Column, pattern, a: Analyzer = FULL_TEXT) -> Column:
    pattern, weights = _unpack(pattern)
    return _never(col) if not pattern else _in_array(col, lambda x: F.regexp_like(x, F.lit(translate_regexp(pattern))), weights, a)


def regexp_any(col: Column, patterns: Iterable[str | None], a: Analyzer = FULL_TEXT) -> Column:
    return _any(regexp(col, p, a) for p in patterns if p)


def like(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.ilike(pattern) if ignore_case else col.like(pattern)


def like_as_regexp(pattern: str) -> str:
    """A LIKE pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
            out += ("\\" if c in r".^$*+?()[]{}|\/" else "") + c
        else:
            out += {"%": ".*", "_": "."}.get(c, ("\\" if c in r".^$*+?()[]{}|\/" else "") + c)
        i += 1
    out = out[2:] if pattern.startswith("%") else "\\A" + out
    return out[:-2] if pattern.endswith("%") and not pattern.endswith("\\%") and out.endswith(".*") else out + "\\z"


def is_in(col: Column, values: Iterable) -> Column:
    """IN with null members passed over; an empty list holds for nothing. Null stays null, so that the scan can take it."""
    wanted = [v for v in values if v is not None]
    return col.isin(wanted) if wanted else F.lit(False)


def compare(col: Column, op: str, value, a: Analyzer | None = None) -> Column:
    """<, <=, =, >=, > by value; with an analyzer, of normalised text. Null stays null, so that the scan can take the comparison."""
    c, v = (normalize(col, a.normalizer), _term(value, a)) if a else (col, F.lit(value))
    return {"<": c < v, "<=": c <= v, "=": c == v, ">=": c >= v, ">": c > v}[op]


def script(col_map: dict[str, Column], text: str, arrays: frozenset = frozenset()) -> Column:
    """The script language over named columns. Null stays null, so that the scan can take comparisons."""
    from ..plans.script import compile_script

    return compile_script(text, col_map, arrays)


def fuzzy_distance(ratio: float, term: str) -> int:
    return int(ratio * len(term))


def keywords(q: str) -> list[str]:
    return [x.text for x in leaves(parse(q), positive_only=True)]
