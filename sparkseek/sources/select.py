"""The `select` command as a DataFrame builder: filter by script, query over columns, sort, page and choose output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, Analyzer
from ..operators import predicates as P


def select(table: DataFrame, filter: str | None = None, match_columns: str | None = None, query: str | None = None, output_columns: str = "*", sort_keys: str | None = None, offset: int = 0, limit: int = 10, analyzer: Analyzer = FULL_TEXT) -> DataFrame:
    """Rows of a table as the command returns them; a limit under 0 is none. match_columns: 'title || content'. sort_keys: '-score,id'."""
    out = table
    arrays = frozenset(f.name for f in table.schema if f.dataType.typeName() == "array")
    if filter:
        out = out.filter(P.script({c: F.col(c) for c in table.columns}, filter, arrays))
    if query:
        found = F.lit(False)
        for name in (c.split("*")[0].strip() for c in (match_columns or "").split("||")):
            found = found | (P.query_array(F.col(name), query, analyzer) if name in arrays else P.query(F.col(name), query, analyzer, {c: F.col(c) for c in table.columns}))
        out = out.filter(found)
    if sort_keys:
        out = out.orderBy(*[F.desc(k[1:]) if k.startswith("-") else F.asc(k.lstrip("+")) for k in (x.strip() for x in sort_keys.split(","))])
    if offset:
        out = out.offset(offset)
    if limit >= 0:
        out = out.limit(limit)
    names = [c.strip() for c in output_columns.split(",")]
    return out if names == ["*"] else out.select(*names)
