"""Rows with a digest in sorted order, each compared with its neighbour: which of them have an equal before them, and where the first stands.

Sorting is by range over all columns, so that a digest however common is spread over tasks, and comparing is one pass with one row
held. A run of equals that crosses partitions shows in the heads of their edge runs, two a partition at most; the least of such
a run is handed to all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_parts, tidy

#: A digest of 96 bits, a document and a place in it.
NAMES = ["h", "c", "doc", "place"]
ROWS = "h long, c int, doc long, place long"
_FOUND = f"edge boolean, {ROWS}, first_doc long, first_place long"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
#: A null document; it ranks before all others.
NO_ID = -(1 << 63)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def batch_of(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows from two digests of 64 bits, of which the second gives 32."""
    return pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array((lo >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(place)], NAMES)


def _compare(batches: Iterator[pa.RecordBatch], heads: bool, places: bool) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition the rows with an equal row before them (heads: or after them) and the first of their run here; and the
    heads of its first and last run as edges. The digest is left out where the run can't reach an edge."""

    def out(edge: bool, cols: list, first: tuple, open_: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(c, t, mask=~open_ if i < 2 else None) for i, (c, t) in enumerate(zip(cols, _TYPES))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), edge)), *arrays, pa.array(first[0]), pa.array(first[1]) if places else pa.nulls(len(first[1]), pa.int64())], ["edge", *NAMES, "first_doc", "first_place"])

    def one(edge: bool, row: tuple) -> pa.RecordBatch:
        cols = [np.array([x]) for x in row]
        return out(edge, cols, (cols[2], cols[3]), np.array([True]))

    held: list | None = None  # the row before, the head of its run, whether that is told, and the digest of the first run
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is None:
            top = tuple(c[0] for c in cols)
            yield one(True, top)
            held = [None, top, False, top[:2]]
        else:
            cols = [np.r_[np.array([x], c.dtype), c] for x, c in zip(held[0], cols)]
        h, c, doc, place = cols
        alike = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])]
        begin = np.maximum.accumulate(np.where(alike, 0, np.arange(len(h))))
        old = begin == 0  # of the run that was open
        first = np.where(old, held[1][2], doc[begin]), np.where(old, held[1][3], place[begin])
        repeat = alike & ~np.r_[False, (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])]  # not the same row again
        open_ = (begin == begin[-1]) | (h == held[3][0]) & (c == held[3][1])
        if repeat.any():
            yield out(False, [x[repeat] for x in cols], tuple(f[repeat] for f in first), open_[repeat])
        if heads:
            of = np.unique(begin[repeat])
            if len(of) and of[0] == 0:
                if not held[2]:
                    yield one(False, held[1])
                held[2], of = True, of[1:]
            if len(of):
                yield out(False, [x[of] for x in cols], (doc[of], place[of]), open_[of])
        b = int(begin[-1])
        if b:
            held[1], held[2] = tuple(x[b] for x in cols), bool(repeat[b:].any())
        held[0] = tuple(x[-1] for x in cols)
    if held is not None:
        yield one(True, held[1])
    tidy()


def repeated(rows: DataFrame, heads: bool = False, places: bool = True, name: str = "compared") -> DataFrame:
    """Rows (doc, place, first_doc, first_place) of those of (h, c, doc, place) whose digest has an earlier row by (doc, place); where the earliest stands.

    heads: earliest rows that have an equal are given too. places: first_place is wanted. A row that occurs twice is one, but may
    come out twice.
    """
    order = rows.repartitionByRange(n_parts(rows.sparkSession), *NAMES).sortWithinPartitions(*NAMES)
    found = cut(order.mapInArrow(lambda it: _compare(it, heads, places), _FOUND), name)
    edge = found.filter("edge").select(*NAMES).distinct()
    crossing = F.broadcast(edge.groupBy("h", "c").agg(F.min(F.struct("doc", "place")).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"))  # two rows a partition at most
    sure = found.filter("not edge").join(crossing, ["h", "c"], "left")
    sure = sure.select("doc", "place", F.coalesce("least.doc", "first_doc").alias("first_doc"), F.coalesce("least.place", "first_place").alias("first_place"))
    more = edge.join(crossing, ["h", "c"])
    if not heads:
        more = more.filter("doc <> least.doc or place <> least.place")
    return sure.unionByName(more.select("doc", "place", F.col("least.doc").alias("first_doc"), F.col("least.place").alias("first_place")))
