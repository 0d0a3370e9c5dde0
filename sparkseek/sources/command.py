"""Commands as text, with JSON answers: select with drilldown, status, schema, table_list, column_list, object_exist, normalize and tokenize."""

from __future__ import annotations

import json
import shlex
import time
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize_text
from ..functions.tokenize import analyzer_of, tokenize
from .select import select

#: Rows that an answer has at most; sources.select gives a DataFrame for more.
ANSWER_ROWS = 100_000
#: What the first argument of a command is called.
FIRST = {"select": "table", "column_list": "table", "normalize": "normalizer", "tokenize": "tokenizer"}

#: Type names of answers, by Spark's.
TYPES = {"boolean": "Bool", "byte": "Int8", "short": "Int16", "integer": "Int32", "long": "Int64", "float": "Float32", "double": "Float", "decimal": "UInt64", "timestamp": "Time", "timestamp_ntz": "Time", "date": "Time", "string": "LongText", "array": "LongText"}


class CommandError(ValueError):
    pass


def parse_command(text: str, arguments: list[str] | None = None) -> tuple[str, dict[str, str]]:
    """Name and arguments of a command line, or of a name with a list of names and values in turn."""
    words = shlex.split(text)
    if not words:
        raise CommandError("no command")
    given: dict[str, str] = {}
    rest = words[1:]
    while rest:
        if rest[0].startswith("--"):
            name, has, value = rest[0][2:].partition("=")
            if not has:
                if len(rest) < 2:
                    raise CommandError(f"no value for {rest[0]}")
                value, rest = rest[1], rest[1:]
            given[name] = value
        else:
            given.setdefault(FIRST.get(words[0], "name"), rest[0])
        rest = rest[1:]
    if arguments:
        if len(arguments) % 2:
            raise CommandError(f"no value for {arguments[-1]}")
        given |= dict(zip(arguments[::2], arguments[1::2]))
    return words[0], given


def _value(v):
    if isinstance(v, datetime):
        return (v if v.tzinfo else v.replace(tzinfo=timezone.utc)).timestamp()
    return int(v) if isinstance(v, Decimal) else v


def _times(df: DataFrame) -> DataFrame:
    """Times as seconds since 1970, whatever the session's and the machine's time zones."""
    seconds = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000.0)).alias(c)
    return df.select(*[seconds(f.name) if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else f.name for f in df.schema])


def _select(tables: dict[str, DataFrame], given: dict[str, str]) -> dict:
    known = {"drilldown", "drilldown_limit", "drilldown_sort_keys", "table", "filter", "match_columns", "query", "output_columns", "sort_keys", "offset", "limit", "command_version"}
    if unknown := sorted(set(given) - known):
        raise CommandError(f"unknown argument: {unknown[0]}")
    if given.get("table") not in tables:
        raise CommandError(f"no table: {given.get('table')}")
    table = tables[given["table"]]
    asked = {k: given[k] for k in ("filter", "match_columns", "query", "output_columns", "sort_keys") if given.get(k)}
    every = select(table, **{k: v for k, v in asked.items() if k in ("filter", "match_columns", "query")}, limit=-1)
    limit = int(given.get("limit", 10))
    found = select(table, **asked, offset=int(given.get("offset", 0)), limit=limit if 0 <= limit <= ANSWER_ROWS else ANSWER_ROWS + 1)
    columns = [{"name": f.name, "type": TYPES.get(f.dataType.typeName(), "LongText")} for f in found.schema]
    records = [[_value(v) for v in r] for r in _times(found).collect()]
    if len(records) > ANSWER_ROWS:
        raise CommandError(f"an answer has {ANSWER_ROWS} rows at most")
    return {"n_hits": every.count(), "columns": columns, "records": records, "drilldowns": [_drilldown(every, k.strip(), given) for k in given.get("drilldown", "").split(",") if k.strip()]}


def _drilldown(hits: DataFrame, key: str, given: dict[str, str]) -> dict:
    """Values of a column and how many hits have each; the most frequent first unless another order is given."""
    if key not in hits.columns:
        raise CommandError(f"no column: {key}")
    groups = hits.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_nsubrecs"))
    order = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in (x.strip() for x in given.get("drilldown_sort_keys", "-_nsubrecs,_key").split(","))]
    limit = int(given.get("drilldown_limit", 10))
    rows = _times(groups.orderBy(*order).limit(limit if 0 <= limit <= ANSWER_ROWS else ANSWER_ROWS + 1)).collect()
    if len(rows) > ANSWER_ROWS:
        raise CommandError(f"an answer has {ANSWER_ROWS} rows at most")
    return {"n_hits": groups.count(), "columns": [{"name": "_key", "type": TYPES.get(hits.schema[key].dataType.typeName(), "LongText")}, {"name": "_nsubrecs", "type": "Int32"}], "records": [[_value(v) for v in r] for r in rows]}


def _listed(part: dict) -> list:
    return [[part["n_hits"]], [[c["name"], c["type"]] for c in part["columns"]], *part["records"]]


def _columns(df: DataFrame, name: str) -> list:
    head = [["id", "UInt32"], ["name", "ShortText"], ["type", "ShortText"], ["domain", "ShortText"], ["range", "ShortText"]]
    kind = lambda t: ("vector", TYPES.get(t.elementType.typeName(), "LongText")) if t.typeName() == "array" else ("fix" if t.typeName() != "string" else "var", TYPES.get(t.typeName(), "LongText"))
    return [head, *([i, f.name, kind(f.dataType)[0], name, kind(f.dataType)[1]] for i, f in enumerate(df.schema, 256))]


def command(spark: SparkSession, tables: dict[str, DataFrame], text: str, arguments: list[str] | None = None) -> str:
    """The answer of a command as JSON text, of command_version 1 (an array) or 3 (an object).

    select returns 10 rows as long as no other limit is given, and ANSWER_ROWS at most: what it returns comes to the driver, and
    sources.select gives a DataFrame for more. drilldown counts the hits by each of the columns named. What is wrong with a command is
    told in the header.
    """
    began, version = time.time(), "1"
    try:
        name, given = parse_command(text, arguments)
        version = given.get("command_version", "1")
        if name == "select":
            body = _select(tables, given)
            if version != "3":
                body = [_listed(body), *map(_listed, body["drilldowns"])]
            elif not body["drilldowns"]:
                del body["drilldowns"]
        elif name == "status":
            body = {"alloc_count": 0, "start_time": spark.sparkContext.startTime / 1000, "uptime": int(began - spark.sparkContext.startTime / 1000), "version": spark.version, "n_queries": 0, "command_version": int(version)}
        elif name == "schema":
            body = {"tables": {t: {"name": t, "columns": {f.name: {"name": f.name, "type": TYPES.get(f.dataType.typeName(), "LongText")} for f in df.schema}} for t, df in tables.items()}}
        elif name == "table_list":
            body = [[["id", "UInt32"], ["name", "ShortText"]], *([i, t] for i, t in enumerate(sorted(tables), 256))]
        elif name == "column_list":
            if given.get("table") not in tables:
                raise CommandError(f"no table: {given.get('table')}")
            body = _columns(tables[given["table"]], given["table"])
        elif name == "normalize":
            body = {"normalized": normalize_text(given.get("string", ""), given.get("normalizer", "auto")), "types": [], "checks": []}
        elif name == "tokenize":
            options = {k: v for k, v in given.items() if k in ("tokenizer", "normalizer", "token_filters")}
            body = [{"value": t["value"], "position": t["position"], "force_prefix": t["force_prefix_search"]} for t in tokenize(given.get("string", ""), analyzer_of({"normalizer": "none"} | options))]
        elif name == "object_exist":
            body = given.get("name") in tables
        else:
            raise CommandError(f"unknown command: {name}")
        code, why = 0, ""
    except Exception as e:  # as a command's answer tells it
        body, code, why = None, -22, str(e)
    took = time.time() - began
    if version == "3":
        return json.dumps({"header": {"return_code": code, "start_time": began, "elapsed_time": took} | ({"error": {"message": why}} if code else {}), "body": body}, ensure_ascii=False)
    return json.dumps([[code, began, took, *([why] if code else [])], *([] if code else [body])], ensure_ascii=False)
