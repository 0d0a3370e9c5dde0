"""Substring dedup by hashing of lines and sentences: the earliest occurrence of a passage stays, the others go.

Units are lines, and the sentences inside them. Each unit is normalised and digested where its document is read; digests are
grouped globally by sorting, and a unit is repeated if its digest stands earlier by (doc_id, unit). One short line or sentence that
occurs twice is no passage, so what goes are runs of adjacent repeated units that have RUN_WORDS words together. The run, not the
unit, bears the length: a passage that one document has in one line and another wrapped in several goes all the same. RUN_WORDS
is three fifths of a passage of 50 words, as its first and last sentence may be cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spread import spread
from .common import SPACE, cut, tidy
from .order import NO_ID, ROWS, batch_of, ids_of
from .order import repeated as repeated_rows

RUN_WORDS = 30
#: A stretch of so many characters counts as a word at least, so that scripts without blanks have words.
WIDE = 10
#: A unit ends after a line feed or a sentence sign before white space, and the white space that follows.
END = rf"(?:[.!?][{SPACE}]|\n)[{SPACE}]*"
_end = re.compile(END)


def units(text: str) -> list[tuple[int, int]]:
    """[start, end) of each unit in characters; together they are the text."""
    ends = [m.end() for m in _end.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def words_of(unit: str) -> list[bytes]:
    return unit.encode().lower().split()


def weight(unit: str) -> int:
    """Words that a unit counts for in its run."""
    return max(len(words_of(unit)), len(unit) // WIDE)


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, c, doc, place): digest, document and number of each unit that has a word; A-Z lower-cased and runs of white space as one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw, nos, sizes = [], [], []
                for t in part.column(1).to_pylist():
                    n = len(nos)
                    for no, (a, b) in enumerate(units(t or "")):
                        if words := words_of(t[a:b]):
                            raw.append(xxhash.xxh3_128_digest(b" ".join(words)))
                            nos.append(no)
                    sizes.append(len(nos) - n)
                d = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
                yield batch_of(np.ascontiguousarray(d[:, 0]), d[:, 1], np.repeat(ids_of(part.column(0)), sizes), np.array(nos, np.int64))
        tidy()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, ROWS)


def runs(text: str, repeated: list[int], least: int) -> list[int]:
    """Of the repeated units of a text, in order, those in runs of `least` words or more."""
    spans, out, open_, n = units(text), [], [], 0
    for u in [u for u in repeated if u < len(spans)] + [-1]:
        if open_ and u != open_[-1] + 1:
            if n >= least:
                out += open_
            open_, n = [], 0
        if u >= 0:
            open_.append(u)
            n += weight(text[slice(*spans[u])])
    return out


def dedup_lines(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """One row per row of docs: (doc_id, text, n_units, n_removed, kept, removed).

    text is what is left; kept has [start, end) of each stretch that stays in the original text, in characters; removed has those
    of the units that went, each with the doc_id and number of its earliest occurrence. least: words of a run that goes; 1 takes
    every repeated unit. A null text stays null without units. Rows with the same doc_id count as one document: equal rows fare
    alike. A null doc_id ranks before all others. Empty tables give no rows.
    """
    found = repeated_rows(cut(occurrences(docs), "units"), name="repeated-units").distinct()
    gone = found.groupBy(F.col("doc").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("unit"), "first_doc", F.col("first_place").cast("int").alias("first_unit")))).alias("gone"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = base.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).join(gone, "k", "left").select("doc_id", "text", "gone.unit", "gone.first_doc", "gone.first_unit")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    away = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc_id", pa.int64()), ("first_unit", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, counts, fewer, kept, removed = [], [], [], [], []
                for t, nos, ids, firsts in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                    spans = units(t or "")
                    first = {u: (None if i == NO_ID else i, f) for u, i, f in zip(nos or (), ids or (), firsts or ())}
                    out = runs(t or "", nos or [], least)
                    edges = [0, *(x for u in out for x in spans[u]), len(t or "")]
                    stay = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
                    texts.append(None if t is None else "".join([t[a:b] for a, b in stay]))
                    counts.append(len(spans))
                    fewer.append(len(out))
                    kept.append([{"start": a, "end": b} for a, b in stay])
                    removed.append([{"start": spans[u][0], "end": spans[u][1], "first_doc_id": first[u][0], "first_unit": first[u][1]} for u in out])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(fewer, pa.int32()), pa.array(kept, pa.list_(span)), pa.array(removed, pa.list_(away))], ["doc_id", "text", "n_units", "n_removed", "kept", "removed"])
        tidy()

    return both.mapInArrow(run, "doc_id long, text string, n_units int, n_removed int, kept array<struct<start:int,end:int>>, removed array<struct<start:int,end:int,first_doc_id:long,first_unit:int>>")
