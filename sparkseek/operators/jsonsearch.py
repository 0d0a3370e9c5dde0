"""Search inside JSON documents by their leaves: every scalar, array and object with its paths, type and value."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, Analyzer
from ..functions.normalize import normalize
from ..plans.query import Leaf
from ..plans.scan import query_condition
from ..plans.script import compile_script

LEAVES = "array<struct<path:string,paths:array<string>,type:string,string:string,number:double,boolean:boolean,size:int>>"


def _dot(parts: tuple) -> str:
    return "".join(f".{p}" for p in parts if p is not None)


def _bracket(parts: tuple, arrays: bool) -> str:
    return "".join("[]" if p is None else f"[{json.dumps(p, ensure_ascii=False)}]" for p in parts if p is not None or arrays)


@lru_cache(maxsize=65_536)
def paths_of(parts: tuple) -> tuple[str, ...]:
    """All spellings of a path: absolute ones, and the relative ones of each tail; array steps are None."""
    out = ["." + _dot(parts)[1:], "." + _bracket(parts, False), "." + _bracket(parts, True)]
    for i in range(len(parts)):
        tail = parts[i:]
        out += [_dot(tail)[1:], _bracket(tail, False), _bracket(tail, True)]
    return tuple(dict.fromkeys(p for p in out if p))


FIELDS = ("path", "paths", "type", "string", "number", "boolean", "size")


def _double(value: int | float) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def _walk(value, parts: tuple, out: list[tuple]) -> None:
    """Leaves of a value in FIELDS order; containers follow what they hold."""
    kind = string = number = boolean = size = None
    if isinstance(value, bool):
        kind, boolean = "boolean", value
    elif isinstance(value, (int, float)):
        kind, number = "number", _double(value)
    elif isinstance(value, str):
        kind, string = "string", value
    elif isinstance(value, list):
        kind, size = "array", len(value)
        for v in value:
            _walk(v, (*parts, None), out)
    elif isinstance(value, dict):
        kind, size = "object", len(value)
        for k, v in value.items():
            _walk(v, (*parts, k), out)
    paths = paths_of(parts)
    out.append(("." + _bracket(parts, True), paths, kind or "null", string, number, boolean, size))


def _leaves_of(text: str | None) -> list[tuple] | None:
    if text is None:
        return None
    try:
        top = json.loads(text)
    except ValueError:
        return None
    out: list[tuple] = []
    _walk(top, (), out)
    return out


def flatten(text: str | None) -> list[dict] | None:
    """Leaves of a JSON text; None for null and for what is no JSON."""
    found = _leaves_of(text)
    return None if found is None else [dict(zip(FIELDS, x)) | {"paths": list(x[1])} for x in found]


_TYPES = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.int32())


def json_leaves(col: Column) -> Column:
    """Leaves of a column of JSON texts, built column by column in Arrow batches."""

    @F.arrow_udf(LEAVES)
    def run(texts: pa.Array) -> pa.Array:
        offsets, rows = [], []
        for t in texts.to_pylist():
            found = _leaves_of(t)
            offsets.append(None if found is None else len(rows))
            rows += found or ()
        offsets.append(len(rows))
        columns = zip(*rows) if rows else ((),) * len(FIELDS)
        fields = [pa.array(c, t) for c, t in zip(columns, _TYPES)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, FIELDS))

    return run(col)


def _some(leaves: Column, test) -> Column:
    return F.coalesce(F.exists(leaves, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def json_match(leaves: Column, term: str | None, a: Analyzer = FULL_TEXT) -> Column:
    """Some string in the document contains the term, both normalised."""
    if not term:
        return F.lit(False)
    return _some(leaves, lambda x: normalize(x["string"], a.normalizer).contains(normalize(F.lit(term), a.normalizer)))


def json_query(leaves: Column, query: str | None, a: Analyzer = FULL_TEXT) -> Column:
    """Query language; all its terms must be met by one and the same string. Syntax errors raise."""
    if not query or not query.strip():
        return F.lit(False)

    def one(x: Column) -> Column:
        text = normalize(x["string"], a.normalizer)
        return query_condition(query, lambda leaf: _term(text, leaf, a), strict=True)

    return _some(leaves, one)


def _term(text: Column, leaf: Leaf, a: Analyzer) -> Column:
    t = normalize(F.lit(leaf.text), a.normalizer)
    return F.exists(F.split(text, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w.startswith(t)) if leaf.kind == "prefix" else text.contains(t)


def json_script(leaves: Column, script: str) -> Column:
    """Script language over the columns of a leaf: path, paths, type, string, number, boolean, size."""
    return _some(leaves, lambda x: compile_script(script, {n: x[n] for n in ("path", "paths", "type", "string", "number", "boolean", "size")}, frozenset({"paths"})))


def json_contains(leaves: Column, part: str) -> Column:
    """Containment: each scalar and each empty container of `part` is in the document at the same path."""
    wanted = flatten(part)
    if wanted is None:
        raise ValueError("not a JSON text")
    out = leaves.isNotNull()
    for w in wanted:
        if w["type"] in ("array", "object") and w["size"]:
            continue

        def same(x: Column, w=w) -> Column:
            c = (x["path"] == w["path"]) & (x["type"] == w["type"])
            if w["type"] in ("string", "number", "boolean"):
                c = c & (x[w["type"]] == F.lit(w[w["type"]]))
            return c

        out = out & _some(leaves, same)
    return F.coalesce(out, F.lit(False))


def json_full_text(leaves: Column) -> Column:
    """All strings of a document, as an array to index or match."""
    return F.filter(F.transform(leaves, lambda x: x["string"]), lambda s: s.isNotNull())
