"""How results are shown: match positions, highlights, snippets, escapes, query expansion and conversion of result texts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, Analyzer
from .normalize import PLAIN, normalize_text, normalize_with_offsets
from .tokenize import located, query_terms, tokens_of

TAG = ('<span class="keyword">', "</span>")


@lru_cache(maxsize=512)
def _pattern(keywords: tuple[str, ...], normalizer: str | None) -> re.Pattern | None:
    wanted = sorted({normalize_text(k, normalizer) for k in keywords if k} - {""}, key=lambda k: (-len(k), k))
    return re.compile("|".join(map(re.escape, wanted))) if wanted else None


def spans(text: str, keywords, a: Analyzer = FULL_TEXT) -> list[tuple[int, int]]:
    """[start, end) of keyword matches in characters of the original text, leftmost and longest first.

    If the analyzer's tokenizer reports source locations, matches are of whole tokens in sequence, and begin with the blanks before
    their first token; otherwise they are of the normalised text.
    """
    if located(a):
        return _token_spans(text, tuple(k for k in keywords if k), a)
    pattern = _pattern(tuple(k for k in keywords if k is not None), a.normalizer)
    if pattern is None:
        return []
    folded, back = normalize_with_offsets(text, a.normalizer)
    out: list[tuple[int, int]] = []
    for m in pattern.finditer(folded):
        start, end = back[m.start()], back[m.end()] if m.end() < len(back) else len(text)
        end = max(end, back[m.end() - 1] + 1)
        if out and start < out[-1][1]:
            continue
        out.append((start, end))
    return out


def _token_spans(text: str, keywords: tuple[str, ...], a: Analyzer) -> list[tuple[int, int]]:
    tokens = tokens_of(text, a)
    place = {t.position: i for i, t in enumerate(tokens)}
    wanted = [w for w in (query_terms(k, a) for k in keywords) if w]
    out: list[tuple[int, int]] = []
    for t in tokens:
        best = 0
        for w in wanted:
            at = [place.get(t.position + k - w[0][0]) for k, _, _ in w]
            if all(i is not None and (tokens[i].value.startswith(v) if gram else tokens[i].value == v) for i, (_, v, gram) in zip(at, w)):
                last = tokens[at[-1]]
                best = max(best, last.end if not w[-1][2] else min(last.end, last.start + len(w[-1][1])))
        if best and (not out or t.start >= out[-1][1]):
            out.append((max(t.blank, out[-1][1]) if out else t.blank, best))
        elif best and best > out[-1][1]:  # overlaps the match before: one longer match
            out[-1] = (out[-1][0], best)
    return out


def match_positions_character(text: str, keywords, a: Analyzer = FULL_TEXT) -> list[list[int]]:
    return [[s, e - s] for s, e in spans(text, keywords, a)]


def match_positions_byte(text: str, keywords, a: Analyzer = FULL_TEXT) -> list[list[int]]:
    size = lambda s: len(s.encode())
    return [[size(text[:s]), size(text[s:e])] for s, e in spans(text, keywords, a)]


def highlight_html(text: str, keywords, a: Analyzer = FULL_TEXT, tag: tuple[str, str] = TAG) -> str:
    """The text as HTML, its matches tagged."""
    out, at = [], 0
    for s, e in spans(text, keywords, a):
        out += [_html(text[at:s]), tag[0], _html(text[s:e]), tag[1]]
        at = e
    return "".join([*out, _html(text[at:])])


def _html(s: str) -> str:
    return html.escape(s, quote=False).replace('"', "&quot;")


def snippet_html(text: str, keywords, width: int = 200, most: int = 3, a: Analyzer = FULL_TEXT) -> list[str]:
    """At most three stretches of `width` bytes around matches, as HTML with the matches tagged."""
    if width < 1:
        raise ValueError(f"width must be a positive number: {width}")
    raw, out, upto = text.encode(), [], 0
    found = [(s, s + n) for s, n in match_positions_byte(text, keywords, a)]
    while found and len(out) < most:
        start, end = found[0]
        if start < upto or end - start > width:
            found.pop(0)
            continue
        begin = max(upto, start - (width - (end - start) + 1) // 2)
        while begin < start and raw[begin] & 0xC0 == 0x80:
            begin += 1
        stop = min(len(raw), begin + width)
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        parts, at = [], begin
        while found and found[0][1] <= stop:
            s, e = found.pop(0)
            parts += [_html(raw[at:s].decode()), TAG[0], _html(raw[s:e].decode()), TAG[1]]
            at = e
        out.append("".join([*parts, _html(raw[at:stop].decode())]))
        upto = stop
    return out


def _rows(function, returns: str):
    def column(col: Column, keywords, *args, **options) -> Column:
        @F.pandas_udf(returns)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda t: None if t is None else function(t, keywords, *args, **options))

        return run(col)

    column.__name__ = f"{function.__name__}_column"
    column.__doc__ = f"{function.__name__} of a text column, by Arrow batches; null stays null."
    return column


_highlight_rows = _rows(highlight_html, "string")

def highlight_html_column(col: Column, keywords, a: Analyzer = FULL_TEXT, tag: tuple[str, str] = TAG) -> Column:
    """highlight_html of a text column; null stays null.

    Texts that normalisation changes in nothing but case are tagged by native functions, and only the others go to Python.
    """
    wanted = [k for k in keywords if k]
    if a.normalizer != "auto" or a.substitutions or located(a) or not wanted or not all(re.fullmatch(PLAIN, k) for k in wanted):
        return _highlight_rows(col, keywords, a, tag)
    signs = str.maketrans({c: "\\" + c for c in r"\^$.|?*+()[]{}"})
    pattern = "|".join(k.translate(signs) for k in sorted({k.lower() for k in wanted}, key=lambda k: (-len(k), k)))
    marked = F.regexp_replace(col, f"(?iu)({pattern})", "\x02$1\x03")  # signs that no such text has, until all else is escaped
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\x02", tag[0]), ("\x03", tag[1])):
        marked = F.replace(marked, F.lit(sign), F.lit(by))
    simple = F.regexp_like(col, F.lit(f"\\A{PLAIN}\\z"))
    return F.when(simple, marked).otherwise(_highlight_rows(F.when(~simple, col), keywords, a, tag))


highlight_html_array_column = _rows(lambda texts, keywords, *a: [None if t is None else highlight_html(t, keywords, *a) for t in texts], "array<string>")
match_positions_byte_array_column = _rows(lambda texts, keywords, *a: [None if t is None else match_positions_byte(t, keywords, *a) for t in texts], "array<array<array<int>>>")
match_positions_character_array_column = _rows(lambda texts, keywords, *a: [None if t is None else match_positions_character(t, keywords, *a) for t in texts], "array<array<array<int>>>")
snippet_html_column = _rows(snippet_html, "array<string>")
match_positions_byte_column = _rows(match_positions_byte, "array<array<int>>")
match_positions_character_column = _rows(match_positions_character, "array<array<int>>")

_SPECIAL = r'([+\-<>~*()"\\:])'


def query_escape(col: Column) -> Column:
    """Signs of the query language lose their meaning."""
    return F.regexp_replace(col, _SPECIAL, r"\\$1")


def command_escape_value(col: Column) -> Column:
    quoted = F.regexp_replace(F.regexp_replace(col, r'(["\\])', r"\\$1"), "\n", r"\\n")
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def escape(col: Column, kind: str = "string", special: str = '"\\') -> Column:
    """A value as a literal of the script language. kind: its SQL type."""
    if kind == "string":
        signs = "".join("\\" + c if c in r"\]^-[&" else c for c in special)
        return F.concat(F.lit('"'), F.regexp_replace(col, f"([{signs}])", r"\\$1") if special else col, F.lit('"'))
    if kind == "float":
        return col.cast("double").cast("string")
    if kind == "timestamp":
        seconds = F.unix_micros(col.cast("timestamp")) / F.lit(1_000_000)
        return F.when(F.unix_micros(col.cast("timestamp")) % 1_000_000 == 0, F.unix_seconds(col.cast("timestamp")).cast("string")).otherwise(seconds.cast("string"))
    return col.cast("string")


def expand_query(query: str, synonyms: dict[str, list]) -> str:
    """Words that have synonyms replaced by them. synonyms: word to its rows, each a text or a list of texts."""
    table: dict[str, list] = {}
    for k, rows in synonyms.items():
        table.setdefault(normalize_text(k), []).extend(rows)

    def group(rows: list) -> str:
        each = []
        for r in rows:
            each.append(" OR ".join(f"({x})" for x in r if x is not None) if isinstance(r, (list, tuple)) else f"({r})")
        one = " OR ".join(e for e in each if e)
        return f"({one})" if one else ""

    def one(m: re.Match) -> str:
        word = m[0]
        if word in ("OR", "(", ")") or not word.strip() or normalize_text(word.strip('"')) not in table:
            return word
        return group(table[normalize_text(word.strip('"'))]) or word

    return re.sub(r'"(?:[^"\\]|\\.)*"|[()]|[^\s()"]+', one, query)


def expand_queries(queries: DataFrame, query_col: str, synonyms: DataFrame, term_col: str, synonyms_col: str) -> DataFrame:
    """queries with `expanded`: each word joined to the synonym table, any size of either, and put together again."""
    array, terms = (synonyms.schema[c].dataType.typeName() == "array" for c in (synonyms_col, term_col))
    if not array and synonyms.schema[synonyms_col].dataType.typeName() != "string":
        raise ValueError(f"the synonyms are neither text nor an array of texts: {synonyms_col}")
    made = F.concat_ws(" OR ", F.transform(F.filter(synonyms_col, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("("), x, F.lit(")")))) if array else F.concat(F.lit("("), F.col(synonyms_col), F.lit(")"))
    each = synonyms.select((F.explode(term_col) if terms else F.col(term_col)).alias("__term"), made.alias("__made"))
    table = each.select(F.lower("__term").alias("__key"), "__made").filter("__made <> ''").groupBy("__key").agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("__made")), " OR "), F.lit(")")).alias("__group"))
    words = queries.select(query_col).distinct().select(query_col, F.posexplode(F.regexp_extract_all(F.col(query_col), F.lit(r'"(?:[^"\\]|\\.)*"|[()]|[^\s()"]+|\s+'), F.lit(0))).alias("__at", "__word"))
    joined = words.withColumn("__key", F.lower("__word")).join(table, "__key", "left")
    whole = joined.groupBy(query_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", F.coalesce("__group", "__word").alias("w")))), lambda x: x["w"]), "").alias("expanded"))
    return queries.join(whole, query_col, "left")


_TYPES = {"Bool": "boolean", "Int8": "byte", "UInt8": "short", "Int16": "short", "UInt16": "int", "Int32": "int", "UInt32": "long", "Int64": "long", "UInt64": "decimal(20,0)", "Float32": "float", "Float": "double", "Time": "double", "ShortText": "string", "Text": "string", "LongText": "string"}


def result_rows(spark, result: str) -> DataFrame:
    """A select result (JSON text: header and rows, of command version 1 or 3) as a DataFrame with the header's names and types."""
    import json
    from datetime import datetime, timezone
    from decimal import Decimal

    top = json.loads(result)
    if isinstance(top, dict):
        body = top["body"]
        columns, rows = [(c["name"], c["type"]) for c in body["columns"]], body["records"]
    else:
        table = (top[1] if isinstance(top[0], list) and len(top[0]) and isinstance(top[0][0], (int, float)) and isinstance(top[0], list) and len(top) > 1 and isinstance(top[1], list) else top)[0]
        columns, rows = [tuple(c) for c in table[1]], table[2:]
    unknown = [t for _, t in columns if t not in _TYPES]
    if unknown:
        raise ValueError(f"unsupported type: {unknown[0]}")
    turn = {"UInt64": Decimal, "Float": float, "Float32": float, "Time": lambda x: datetime.fromtimestamp(float(x), timezone.utc)}
    schema = ", ".join(f"`{n}` {'timestamp' if t == 'Time' else _TYPES[t]}" for n, t in columns)
    return spark.createDataFrame([tuple(None if v is None else turn.get(t, lambda x: x)(v) for v, (_, t) in zip(r, columns)) for r in rows], schema)


def result_objects(result: str) -> str:
    """The same rows as a JSON array of objects."""
    import json

    top = json.loads(result)
    if isinstance(top, dict):
        names, rows = [c["name"] for c in top["body"]["columns"]], top["body"]["records"]
    else:
        table = (top[1] if isinstance(top[0], list) and len(top) > 1 else top)[0]
        names, rows = [c[0] for c in table[1]], table[2:]
    return json.dumps([dict(zip(names, r)) for r in rows], ensure_ascii=False)
