"""The functions under SQL names, for spark.sql(): native ones as SQL functions, the others by Arrow batches.

match, query, prefix, equal, regexp and the like take the column's value and a literal or a column as SQL operators do.
"""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import jsonsearch
from ..operators.vectors import hashing_embedding
from ..plans.query import extract_keywords, fold, parse
from . import present
from .normalize import _FROM, _TO, normalize_plain, normalize_text
from .romaji import reads_as
from .tokenize import SCHEMA, tokenize
from ..conf import Analyzer

#: Native functions: name, arguments, type, body.
NATIVE = [
    ("seek_normalize", "t STRING", "STRING", "lower(if(length(t) = octet_length(t), t, translate(t, '{f}', '{t}')))"),
    ("seek_normalize_each", "ts ARRAY<STRING>", "ARRAY<STRING>", "transform(ts, x -> lower(if(length(x) = octet_length(x), x, translate(x, '{f}', '{t}'))))"),
    ("seek_pattern", "p STRING", "STRING", r"replace(p, r'\h', '[0-9a-fA-F]')"),
    ("seek_match", "t STRING, term STRING", "BOOLEAN", "term <> '' AND contains(seek_normalize(t), seek_normalize(term))"),
    ("seek_match_array", "t ARRAY<STRING>, term STRING", "BOOLEAN", "term <> '' AND exists(seek_normalize_each(t), x -> contains(x, seek_normalize(term)))"),
    ("seek_match_in", "t STRING, terms ARRAY<STRING>", "BOOLEAN", "exists(seek_normalize_each(terms), x -> x <> '' AND contains(seek_normalize(t), x))"),
    ("seek_prefix", "t STRING, p STRING", "BOOLEAN", "p <> '' AND startswith(seek_normalize(t), seek_normalize(p))"),
    ("seek_prefix_array", "t ARRAY<STRING>, p STRING", "BOOLEAN", "p <> '' AND exists(seek_normalize_each(t), x -> startswith(x, seek_normalize(p)))"),
    ("seek_prefix_in", "t STRING, ps ARRAY<STRING>", "BOOLEAN", "exists(seek_normalize_each(ps), x -> x <> '' AND startswith(seek_normalize(t), x))"),
    ("seek_not_prefix_in", "t STRING, ps ARRAY<STRING>", "BOOLEAN", "t IS NOT NULL AND NOT coalesce(exists(seek_normalize_each(ps), x -> x <> '' AND startswith(seek_normalize(t), x)), false)"),
    ("seek_equal", "t STRING, o STRING", "BOOLEAN", "o <> '' AND seek_normalize(t) = seek_normalize(o)"),
    ("seek_contain", "t ARRAY<STRING>, v STRING", "BOOLEAN", "array_contains(t, v)"),
    ("seek_regexp", "t STRING, p STRING", "BOOLEAN", "p <> '' AND regexp_like(seek_normalize(t), seek_pattern(p))"),
    ("seek_regexp_array", "t ARRAY<STRING>, p STRING", "BOOLEAN", "p <> '' AND exists(seek_normalize_each(t), x -> regexp_like(x, seek_pattern(p)))"),
    ("seek_regexp_in", "t STRING, ps ARRAY<STRING>", "BOOLEAN", r"exists(ps, x -> x <> '' AND regexp_like(seek_normalize(t), replace(x, r'\h', '[0-9a-fA-F]')))"),
    ("seek_match_in_array", "t ARRAY<STRING>, terms ARRAY<STRING>", "BOOLEAN", "exists(seek_normalize_each(terms), y -> y <> '' AND exists(seek_normalize_each(t), x -> contains(x, y)))"),
    ("seek_prefix_in_array", "t ARRAY<STRING>, ps ARRAY<STRING>", "BOOLEAN", "exists(seek_normalize_each(ps), y -> y <> '' AND exists(seek_normalize_each(t), x -> startswith(x, y)))"),
    ("seek_contain_all", "t ARRAY<STRING>, vs ARRAY<STRING>", "BOOLEAN", "size(array_except(vs, t)) = 0"),
    ("seek_command_escape_value", "t STRING", "STRING", r"""concat('"', replace(regexp_replace(t, r'(["\\])', r'\\$1'), '\n', r'\n'), '"')"""),
    ("seek_escape", "t STRING", "STRING", r"""concat('"', regexp_replace(t, r'(["\\])', r'\\$1'), '"')"""),
    ("seek_escape_boolean", "v BOOLEAN", "STRING", "cast(v AS STRING)"),
    ("seek_escape_long", "v BIGINT", "STRING", "cast(v AS STRING)"),
    ("seek_escape_double", "v DOUBLE", "STRING", "cast(v AS STRING)"),
    ("seek_escape_timestamp", "v TIMESTAMP", "STRING", "if(unix_micros(v) % 1000000 = 0, cast(unix_seconds(v) AS STRING), cast(unix_micros(v) / 1000000 AS STRING))"),
    ("seek_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"),
    ("seek_query_escape", "t STRING", "STRING", r"regexp_replace(t, r'([+\-<>~*()\"\\:])', r'\\$1')"),
]


def _scan(text: str | None, query: str | None) -> bool | None:
    if text is None or query is None:
        return None
    tree, folded = parse(query), normalize_plain(text)
    if tree is None:
        return False
    return fold(tree, lambda x: bool(x.text) and normalize_plain(x.text) in folded, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def _over_array(texts, query: str | None) -> bool:
    """Query language over elements: terms may be in different ones."""
    tree = parse(query)
    if tree is None:
        return False
    folded = [normalize_plain(t) for t in texts if t is not None]
    return fold(tree, lambda x: bool(x.text) and any(normalize_plain(x.text) in t for t in folded), lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def _equal_over_array(texts, query: str) -> bool:
    tree = parse(query)
    if tree is None:
        return False
    folded = {normalize_plain(t) for t in texts if t is not None}
    leaf = lambda x: any(t.startswith(normalize_plain(x.text)) for t in folded) if x.kind == "prefix" else normalize_plain(x.text) in folded
    return fold(tree, leaf, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def _json_strings(text: str) -> list[str]:
    return [normalize_plain(x["string"]) for x in jsonsearch.flatten(text) or () if x["string"] is not None]


def _json_match(text: str, term: str) -> bool:
    return bool(term) and any(normalize_plain(term) in s for s in _json_strings(text))


def _json_query(text: str, query: str) -> bool:
    tree = parse(query, strict=True)
    leaf = lambda s: lambda x: bool(x.text) and normalize_plain(x.text) in s
    return tree is not None and any(fold(tree, leaf(s), lambda a, b: a and b, lambda a, b: a or b, lambda a: not a) for s in _json_strings(text))


def _json_contains(text: str, part: str) -> bool:
    have, wanted = jsonsearch.flatten(text), jsonsearch.flatten(part)
    if have is None or wanted is None:
        return False
    key = lambda x: (x["path"], x["type"], x.get(x["type"]))
    known = {key(x) for x in have}
    return all(key(w) in known for w in wanted if not (w["type"] in ("array", "object") and w["size"]))


def _each(function, strict: bool = True):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if strict and any(v is None for v in row) else function(*row) for row in zip(*columns)], dtype=object)

    return run


def _one(run):
    def call(a: pd.Series) -> pd.Series:
        return run(a)

    return call


def _two(run):
    def call(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return call


def _three(run):
    def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return call


def register(spark: SparkSession) -> list[str]:
    """Define all functions in the session; their names."""
    literal = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    for name, args, returns, body in NATIVE:
        body = body.replace("'{f}'", f"'{literal(_FROM)}'").replace("'{t}'", f"'{literal(_TO)}'")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")

    def arrow(name: str, returns: str, n: int, function) -> str:
        run = _each(function)
        calls = {1: _one(run), 2: _two(run), 3: _three(run)}
        spark.udf.register(name, F.pandas_udf(calls[n], returns))
        return name

    made = [
        arrow("seek_query", "boolean", 2, _scan),
        arrow("seek_query_in", "boolean", 2, lambda t, qs: any(_scan(t, q) for q in qs if q)),
        arrow("seek_prefix_rk", "boolean", 2, reads_as),
        arrow("seek_query_array", "boolean", 2, _over_array),
        arrow("seek_query_in_array", "boolean", 2, lambda ts, qs: any(_over_array(ts, q) for q in qs if q)),
        arrow("seek_equal_query_array", "boolean", 2, _equal_over_array),
        arrow("seek_prefix_rk_in", "boolean", 2, lambda t, ps: any(reads_as(t, p) for p in ps if p)),
        arrow("seek_prefix_rk_array", "boolean", 2, lambda ts, p: any(t is not None and reads_as(t, p) for t in ts)),
        arrow("seek_prefix_rk_in_array", "boolean", 2, lambda ts, ps: any(t is not None and reads_as(t, p) for t in ts for p in ps if p)),
        arrow("seek_json_match", "boolean", 2, _json_match),
        arrow("seek_json_query", "boolean", 2, _json_query),
        arrow("seek_json_contains", "boolean", 2, _json_contains),
        arrow("seek_highlight_html_array", "array<string>", 2, lambda ts, ks: [None if t is None else present.highlight_html(t, ks) for t in ts]),
        arrow("seek_snippet_html_width", "array<string>", 3, lambda t, ks, width: present.snippet_html(t, ks, int(width))),
        arrow("seek_normalize_with", "string", 2, normalize_text),
        arrow("seek_tokenize", SCHEMA, 2, lambda t, tokenizer: tokenize(t, Analyzer(tokenizer=tokenizer))),
        arrow("seek_highlight_html", "string", 2, present.highlight_html),
        arrow("seek_snippet_html", "array<string>", 2, present.snippet_html),
        arrow("seek_match_positions_byte", "array<array<int>>", 2, present.match_positions_byte),
        arrow("seek_match_positions_character", "array<array<int>>", 2, present.match_positions_character),
        arrow("seek_query_extract_keywords", "array<string>", 1, extract_keywords),
        arrow("seek_result_to_objects", "string", 1, present.result_objects),
        arrow("seek_json_leaves", jsonsearch.LEAVES, 1, jsonsearch.flatten),
        arrow("seek_vectorize", "array<float>", 1, hashing_embedding),
    ]
    return [n for n, *_ in NATIVE] + made
