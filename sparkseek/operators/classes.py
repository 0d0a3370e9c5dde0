"""Operator classes: which operators a column has, by the type of its values and the use it is made for, and how each is evaluated.

A class is chosen per column, as an index declaration does: the same operator sign means another rule in another class, such as `=`
by value in a class for comparing and normalised in one for terms. `apply` gives the Column of an operator on a scan, and `analyzer`
how an index of the class makes its keys. Similarity of tokens (`similar`) is an index's alone; similarity of meaning is that of the
embeddings of operators.vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, PLAIN, REGEXP, TERM, Analyzer
from ..functions.tokenize import analyzer_of
from . import jsonsearch as J
from . import predicates as P
from . import vectors as V

USES = {"full_text_search": FULL_TEXT, "term_search": TERM, "regexp_search": REGEXP, "compare": PLAIN, "json": FULL_TEXT, "semantic_search": FULL_TEXT}


def _script(col: Column, text: str, a: Analyzer) -> Column:
    return P.script({"value": col}, text)


def _distance(col: Column, text: str, a: Analyzer) -> Column:
    return V.cosine_distance(V.vectorize(col), F.array(*map(F.lit, V.hashing_embedding(text))))


def _by_value(sign: str) -> Callable:
    return lambda col, value, a: P.compare(col, sign, value, a if a.normalizer is not None else None)


_COMPARE = {s: _by_value(s) for s in ("<", "<=", "=", ">=", ">")}
_LIKE = {"~~": lambda col, p, a: P.like(col, p), "~~*": lambda col, p, a: P.like(col, p, True)}
_QUERY = {"@@": P.query, "&?": P.query, "&@~": P.query}
_QUERIES = {"&?|": P.query_any, "&?>": P.query_any, "&@~|": P.query_any}
_QUERY_ARRAY = {"@@": P.query_array, "&?": P.query_array, "&@~": P.query_array}
_ROMAJI = {"&^~": lambda col, s, a: P.prefix_romaji(col, s), "&^~|": lambda col, s, a: P.prefix_romaji_any(col, s)}
_ROMAJI_ARRAY = {k: lambda col, s, a: P.prefix_romaji_array_any(col, [s] if isinstance(s, str) or s is None else s) for k in ("&^~", "&^~|", "&^~>")}
_TERMS = _COMPARE | {"&^": P.prefix, "&^|": P.prefix_any, "&=": P.equal} | _ROMAJI
_TERM_ARRAY = {"@>": lambda col, v, a: P.contains_all(col, v), "&^": P.prefix_array, "&^>": P.prefix_array, "&^|": P.prefix_array_any, "&=~": P.equal_query_array} | _ROMAJI_ARRAY
_JSON = {"@>": lambda col, v, a: J.json_contains(col, v), "&@": J.json_match, "%%": J.json_match} | {s: J.json_query for s in ("&?", "&@~")}
_SCRIPTS = {"&`": lambda col, t, a: J.json_script(col, t), "@@": lambda col, t, a: J.json_script(col, t)}
#: Operators by use and whether values are arrays: those that both generations of classes have, and those of the newer one.
_OPERATORS: dict[tuple[str, bool], tuple[dict[str, Callable], dict[str, Callable]]] = {
    ("full_text_search", False): (_LIKE | {"%%": P.match, "&@": P.match} | _QUERY, {"&`": _script, "&@|": P.match_any, "&@>": P.match_any} | _QUERIES),
    ("full_text_search", True): ({"%%": P.match_array, "&@": P.match_array} | _QUERY_ARRAY, {"&`": lambda col, t, a: P.script({"value": col}, t, frozenset({"value"})), "&@|": P.match_array_any, "&?|": P.query_array_any, "&@~|": P.query_array_any}),
    ("term_search", False): ({}, _TERMS | {"!&^|": P.not_prefix_any}),
    ("term_search", True): ({"%%": lambda col, v, a: P.contains_element(col, v), "&>": lambda col, v, a: P.contains_element(col, v)}, _TERM_ARRAY),
    ("regexp_search", False): (_LIKE | {"@~": P.regexp, "&~": P.regexp}, {"&~|": P.regexp_any}),
    ("regexp_search", True): ({}, {"&~": P.regexp_array}),
    ("compare", False): (_COMPARE, {}),
    ("compare", True): ({"=": lambda col, v, a: col == v}, {}),
    ("json", False): (_JSON | _SCRIPTS, {}),
    ("semantic_search", False): ({}, {"<&@*>": _distance, "&@*": lambda col, t, a: F.coalesce(_distance(col, t, a) < 1, F.lit(False))}),
}


@dataclass(frozen=True)
class OperatorClass:
    """values: the type of the column; use: what it is searched for; default: whether the type has it if no class is named."""

    values: str
    use: str
    newer: bool = True
    default: bool = False

    @property
    def name(self) -> str:
        return f"{self.values.replace('[]', '_array')}_{self.use}{'_v2' if self.newer else ''}"

    @property
    def operators(self) -> dict[str, Callable]:
        old, new = _OPERATORS[self.use, self.values.endswith("[]")]
        found = dict(old) | (new if self.newer else {})
        if self.values.startswith("varchar"):  # these have no LIKE, and no negated list of prefixes
            found = {s: f for s, f in found.items() if s not in ("~~", "~~*", "!&^|")}
        elif self.use == "term_search" and self.values == "text[]":
            found = {s: f for s, f in found.items() if s not in ("%%", "&>")}
        elif self.values == "json" and self.use == "full_text_search":
            found = {s: _JSON[s] for s in ("&@", "&@~")}
        return found

    def analyzer(self, column: str | None = None, **options) -> Analyzer:
        """How keys are made, with the options of an index declaration."""
        base = USES[self.use]
        return analyzer_of(options, column, "full_text_search" if self.use in ("json", "compare", "semantic_search") else self.use, base) if options else base

    def apply(self, sign: str, col: Column, operand, **options) -> Column:
        """The operator of the class on a scan; one that the class lacks is an error."""
        if sign not in self.operators:
            raise ValueError(f"{self.name} has no operator {sign}")
        return self.operators[sign](col, operand, self.analyzer(**options))


def _all() -> list[OperatorClass]:
    C = OperatorClass
    texts = [C(v, "full_text_search", newer, newer and v.startswith("text")) for v in ("text", "text[]", "varchar") for newer in (False, True)]
    terms = [C(v, "term_search", True, v.startswith("varchar")) for v in ("text", "text[]", "varchar", "varchar[]")]
    patterns = [C("text", "regexp_search", False), C("varchar", "regexp_search", False), *(C(v, "regexp_search") for v in ("text", "text[]", "varchar"))]
    plain = [C(v, "compare", False, v != "varchar") for v in ("varchar", "bool", "int2", "int4", "int8", "float4", "float8", "timestamp", "timestamptz", "uuid", "int4[]")]
    return [*texts, *terms, *patterns, *plain, C("varchar[]", "term_search", False), C("json", "json", False), C("json", "json", True, True), C("json", "full_text_search"), C("text", "semantic_search")]


#: All classes by name.
CLASSES = {c.name: c for c in _all()}


def default_class(values: str) -> OperatorClass | None:
    """The class of a column whose declaration names none."""
    return next((c for c in CLASSES.values() if c.values == values and c.default), None)
