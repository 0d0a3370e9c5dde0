"""Query trees to Column expressions over the rows themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query import Leaf, fold, parse


def query_condition(query: str, leaf: Callable[[Leaf], Column], columns: bool = False, strict: bool = False) -> Column:
    """A boolean Column; a blank query holds for nothing."""
    tree = parse(query, columns, strict) if query is not None else None
    if tree is None:
        return F.lit(False)
    return fold(tree, leaf, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
