"""The script language over named columns: comparisons, matches and boolean operators, compiled to a Column."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>&&|\|\||&!|==|!=|<=|>=|@\^|@\$|@~|[<>@!(),])|(?P<name>[A-Za-z_]\w*))""")


class ScriptSyntaxError(ValueError):
    pass


def _lex(text: str) -> list[tuple[str, object]]:
    out, i = [], 0
    while i < len(text.rstrip()):
        m = _TOKEN.match(text, i)
        if not m:
            raise ScriptSyntaxError(f"unexpected character at {i}")
        i, kind = m.end(), m.lastgroup
        value: object = m[kind]
        if kind == "str":
            raw = m["str"]
            value = json.loads(raw, strict=False) if raw[0] == '"' else re.sub(r"\\(.)", r"\1", raw[1:-1])
        elif kind == "num":
            value = float(m["num"])
        elif kind == "name" and value in ("true", "false", "null"):
            kind, value = "lit", {"true": True, "false": False, "null": None}[value]
        out.append((kind, value))
    return out


def compile_script(text: str, columns: dict[str, Column], arrays: frozenset = frozenset(), fold=F.lower) -> Column:
    """A boolean Column. columns: what names stand for; arrays: those of them that hold several values, any of which may match."""
    from .scan import query_condition

    items, at = _lex(text), 0

    def peek():
        return items[at] if at < len(items) else ("end", None)

    def take(expected=None):
        nonlocal at
        kind, value = peek()
        if expected is not None and value != expected:
            raise ScriptSyntaxError(f"{expected!r} expected")
        at += 1
        return kind, value

    def name(x) -> Column:
        if x not in columns:
            raise ScriptSyntaxError(f"no column {x!r}")
        return columns[x]

    def any_of(x, test) -> Column:
        return F.exists(name(x), test) if x in arrays else test(name(x))

    def compare(op: str, x, value) -> Column:
        if op == "==":
            if value is None:
                return name(x).isNull()
            return any_of(x, lambda c: c == F.lit(value))
        if op == "!=":
            return ~any_of(x, lambda c: c == F.lit(value))
        if op in ("<", "<=", ">", ">="):
            return any_of(x, lambda c: {"<": c < F.lit(value), "<=": c <= F.lit(value), ">": c > F.lit(value), ">=": c >= F.lit(value)}[op])
        if value == "":
            return F.lit(False)
        if op == "@":
            return F.array_contains(name(x), value) if x in arrays else fold(name(x)).contains(fold(F.lit(value)))
        if op == "@^":
            return any_of(x, lambda c: fold(c).startswith(fold(F.lit(value))))
        if op == "@$":
            return any_of(x, lambda c: fold(c).endswith(fold(F.lit(value))))
        return any_of(x, lambda c: F.regexp_like(fold(c), F.lit(value)))

    def atom() -> Column:
        kind, value = take()
        if value == "(" and kind == "op":
            out = expression()
            take(")")
            return out
        if value == "!" and kind == "op":
            return ~atom()
        if kind == "lit" and isinstance(value, bool) and peek()[0] in ("end", "op") and peek()[1] in (None, "&&", "||", "&!", ")"):
            return F.lit(value)
        if kind == "name" and peek() == ("op", "("):
            take("(")
            args = []
            while peek()[1] != ")":
                args.append(take())
                if peek()[1] == ",":
                    take(",")
            take(")")
            values = [v for _, v in args[1:]]
            target = args[0][1] if args else None
            if value == "query":
                return F.coalesce(query_condition(str(values[0]), lambda leaf: compare({"prefix": "@^"}.get(leaf.kind, "@"), target, leaf.text)), F.lit(False))
            if value == "in_values":
                return any_of(target, lambda c: c.isin(values))
            if value == "between":
                low, lb, high, hb = values if len(values) == 4 else (values[0], "include", values[1], "include")
                return any_of(target, lambda c: (c >= low if lb == "include" else c > low) & (c <= high if hb == "include" else c < high))
            if value == "prefix_rk_search":
                from ..functions.romaji import reads_as_any

                return reads_as_any(name(target), [str(values[0])])
            if value == "all_records":
                return F.lit(True)
            raise ScriptSyntaxError(f"no function {value!r}")
        if kind == "name":
            if peek()[0] == "op" and peek()[1] in ("==", "!=", "<", "<=", ">", ">=", "@", "@^", "@$", "@~"):
                op = take()[1]
                return compare(op, value, take()[1])
            return name(value)
        if kind in ("num", "str", "lit") and peek()[1] in ("==", "!=", "<", "<=", ">", ">="):
            op = take()[1]
            return compare({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), take()[1], value)
        raise ScriptSyntaxError(f"unexpected {value!r}")

    def both() -> Column:
        out = atom()
        while peek()[1] in ("&&", "&!"):
            out = out & atom() if take()[1] == "&&" else out & ~atom()
        return out

    def expression() -> Column:
        out = both()
        while peek()[1] == "||":
            take("||")
            out = out | both()
        return out

    out = expression()
    if peek()[0] != "end":
        raise ScriptSyntaxError(f"unexpected {peek()[1]!r}")
    return out
