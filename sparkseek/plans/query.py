"""The query language: words, phrases, prefixes, AND by default, OR, leading minus, groups, column qualifiers.

Operators have one rank and bind from left to right, so that `a OR b -c` is (a OR b) without c. Nothing is a syntax error unless
strict: what has no partner is a literal keyword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Leaf:
    text: str
    kind: str = "match"  # match, phrase, prefix, equal, similar
    column: str | None = None


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not (not: first without the others; alone: everything without it)
    parts: tuple


class QuerySyntaxError(ValueError):
    pass


_QUALIFIER = re.compile(r"([A-Za-z_]\w*):(@|\^|~|<=|>=|<|>|!)?")


def _lex(query: str, columns: bool) -> list[tuple[str, str, str | None]]:
    """(kind, text, column) of each item: open, close, or, not, word, phrase, prefix."""
    out, i, n = [], 0, len(query)
    while i < n:
        c = query[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append(("open" if c == "(" else "close", c, None))
            i += 1
        elif c == "-" and i + 1 < n and not query[i + 1].isspace():
            out.append(("not", c, None))
            i += 1
        elif c == "+" and i + 1 < n and not query[i + 1].isspace():
            i += 1
        else:
            column, mark = None, ""
            if columns and (m := _QUALIFIER.match(query, i)) and m.end() < n and not query[m.end()].isspace():
                column, mark = m[1], m[2] or "="
                i = m.end()
            if query[i] == '"':
                j, text = i + 1, ""
                while j < n and query[j] != '"':
                    j += query[j] == "\\" and j + 1 < n
                    text += query[j]
                    j += 1
                out.append(("phrase" if j < n else "word", text if j < n else query[i:], column and f"{column}:{mark}"))
                i = j + 1
                continue
            j, text, escaped = i, "", False
            while j < n and not query[j].isspace() and query[j] not in '()"':
                escaped = query[j] == "\\" and j + 1 < n
                j += escaped
                text += query[j]
                j += 1
            i = j
            if text == "OR" and not escaped and not column:
                out.append(("or", text, None))
            elif text.endswith("*") and not escaped and len(text) > 1:
                out.append(("prefix", text[:-1], column and f"{column}:{mark}"))
            else:
                out.append(("word", text, column and f"{column}:{mark}"))
    return out


@lru_cache(maxsize=1024)
def parse(query: str, columns: bool = False, strict: bool = False):
    """The tree of a query, None for a blank one."""
    items = _lex(query, columns)
    depth, opens = 0, []
    for k, (kind, _, _) in enumerate(items):  # brackets without a partner are words
        if kind == "open":
            opens.append(k)
        elif kind == "close":
            if opens:
                opens.pop()
            else:
                depth += 1
                items[k] = ("word", ")", None)
    for k in opens:
        items[k] = ("word", "(", None)
    if strict and (opens or depth):
        raise QuerySyntaxError("unbalanced brackets")

    def sequence(k: int):
        tree, op = None, "and"
        while k < len(items):
            kind, text, column = items[k]
            if kind == "close":
                return tree, k + 1
            if kind == "or":
                if tree is None or k + 1 == len(items) or items[k + 1][0] in ("close", "or"):
                    if strict:
                        raise QuerySyntaxError("OR without two sides")
                    kind = "word"
                else:
                    op = "or"
                    k += 1
                    continue
            negated = False
            while kind == "not":
                negated, k = not negated, k + 1
                if k == len(items) or items[k][0] == "close":
                    kind, text, column, negated = "word", "-", None, False
                    k -= 1
                    break
                kind, text, column = items[k]
            if kind == "open":
                part, k = sequence(k + 1)
            else:
                part, k = Leaf(text, {"word": "match"}.get(kind, kind), column), k + 1
            if part is None:
                continue
            if negated:
                tree = Node("not", (part,)) if tree is None else Node("not", (tree, part)) if op == "and" else Node("or", (tree, Node("not", (part,))))
            elif tree is None:
                tree = part
            elif isinstance(tree, Node) and tree.op == op and op != "not":
                tree = Node(op, (*tree.parts, part))
            else:
                tree = Node(op, (tree, part))
            op = "and"
        return tree, k

    return sequence(0)[0]


def leaves(tree, positive_only: bool = False) -> list[Leaf]:
    """Leaves from left to right; positive_only leaves out what is under a minus."""
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [tree]
    parts = tree.parts
    if tree.op == "not" and positive_only:
        parts = parts[:1] if len(parts) > 1 else ()
    return [x for p in parts for x in leaves(p, positive_only)]


def fold(tree, leaf, and_, or_, not_):
    """The tree's value from values of its leaves."""
    if isinstance(tree, Leaf):
        return leaf(tree)
    values = [fold(p, leaf, and_, or_, not_) for p in tree.parts]
    out = values[0]
    if tree.op == "not":
        if len(values) == 1:
            return not_(out)
        for v in values[1:]:
            out = and_(out, not_(v))
        return out
    for v in values[1:]:
        out = and_(out, v) if tree.op == "and" else or_(out, v)
    return out


def extract_keywords(query: str, columns: bool = False) -> list[str]:
    """Words of a query that are not negated."""
    return [x.text for x in leaves(parse(query, columns), positive_only=True)]
