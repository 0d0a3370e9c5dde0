"""Suffix-array dedup over sparse suffixes.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A repeat is a run of MIN_WORDS words or more that occurs before: any window of
that many words whose equal stands earlier, by (doc_id, place), goes, and its earliest occurrence stays.

1. Suffixes are retained only where a minimiser stands: in each stretch of REACH word 8-grams the one of least digest, leftmost
   first. Equal windows of MIN_WORDS words hold equal 8-grams, so they retain the same place of theirs, and from there share
   MIN_WORDS - REACH + 1 words at least.
2. The retained suffixes are sorted by their leading words, with a digest of so many words to break ties, and neighbours are
   compared: what has no neighbour with so long a common prefix goes.
3. From each suffix that is left the match is extended to the left and right: the windows that retain it are digested, sorted and
   compared with their neighbours in the same way; runs of repeated windows merge into spans with byte offsets.

Sorting and comparing are those of order.py: a passage however common is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_parts, packed, slices, tidy, unpacked
from .order import NO_ID, ROWS, batch_of, ids_of, repeated

MIN_WORDS = 50
GRAM = 8
REACH = 26
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_is_space = np.zeros(256, bool)
_is_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


_powers = np.array([pow(int(_B1), i, 1 << 64) for i in range(1 << 12)], np.uint64)


class Words:
    """The words of several texts: text number, byte offsets in the text, digest."""

    def __init__(self, texts: pa.Array):
        texts = pa.array(texts.fill_null("").to_pylist(), pa.binary()) if texts.null_count else texts.cast(pa.binary())
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        buf = texts.buffers()[2]
        raw = np.frombuffer(buf, np.uint8)[edges[0] : edges[-1]] if buf is not None and edges[-1] > edges[0] else np.empty(0, np.uint8)
        edges = edges - edges[0]
        inside = ~_is_space[raw]
        head = np.zeros(len(raw) + 1, bool)
        head[edges] = True
        start = np.flatnonzero(inside & (head[:-1] | np.r_[True, ~inside[:-1]])) if len(raw) else np.empty(0, np.int64)
        stop = np.flatnonzero(inside & (head[1:] | np.r_[~inside[1:], True])) + 1 if len(raw) else start
        self.text = np.searchsorted(edges, start, "right") - 1
        self.start, self.stop = start - edges[self.text], stop - edges[self.text]
        if len(start):
            size = np.diff(np.r_[start, len(raw)])
            place = np.arange(start[0], len(raw)) - np.repeat(start, size)
            factor = _powers[place & 4095]
            if size.max() > 4096:
                factor = factor * (np.uint64(2) * _mix((place >> 12).astype(np.uint64)) + np.uint64(1))
            value = np.where(inside[start[0] :], (_lower[raw[start[0] :]].astype(np.uint64) + np.uint64(1)) * factor, np.uint64(0))
            self.digest = _mix(np.add.reduceat(value, start - start[0]) + (stop - start).astype(np.uint64))
        else:
            self.digest = np.empty(0, np.uint64)

    def grams(self, n: int, base: np.uint64) -> np.ndarray:
        """Digest of the n words from each word on; where the text ends before, it is of no use."""
        size, have, done, out, at = 1, self.digest, 0, np.zeros(len(self.digest), np.uint64), 0
        total = len(self.digest)
        while True:
            if n & size:
                moved = np.zeros(total, np.uint64)
                moved[: max(0, total - at)] = have[at:] if at < total else have[:0]
                out = out * _power(base, size) + moved
                at += size
                done |= size
            if done == n:
                return _mix(out)
            nxt = np.zeros(total, np.uint64)
            nxt[: max(0, total - size)] = have[size:] if size < total else have[:0]
            have = have * _power(base, size) + nxt
            size *= 2

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from each word on are of its text."""
        out = np.zeros(len(self.text), bool)
        if len(out) >= n:
            out[: len(out) - n + 1] = self.text[n - 1 :] == self.text[: len(out) - n + 1]
        return out

    def anchors(self) -> np.ndarray:
        """For each word that begins a window of MIN_WORDS: the word of the suffix retained for it."""
        value, index = self.grams(GRAM, _B1), np.arange(len(self.digest))
        size = 1
        while size < REACH:
            step = min(size, REACH - size)
            if step >= len(value):
                break
            better = value[step:] < value[:-step]
            value = np.r_[np.where(better, value[step:], value[:-step]), value[-step:]]
            index = np.r_[np.where(better, index[step:], index[:-step]), index[-step:]]
            size += step
        return index


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches whose second column has the texts."""
    for batch in batches:
        yield from slices(batch, batch.column(1))


def _leading(w: Words, at: np.ndarray) -> np.ndarray:
    """16 bits of each of the four words from `at` on, the first highest: what stands together by this number begins alike."""
    code = w.digest >> np.uint64(48)
    return code[at] << np.uint64(48) | code[at + 1] << np.uint64(32) | code[at + 2] << np.uint64(16) | code[at + 3]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained suffixes: their leading words, the digest of their first words, document, first byte."""
    n = MIN_WORDS - REACH + 1
    for part in _slices(batches):
        w = Words(part.column(1))
        at = np.unique(w.anchors()[w.whole(MIN_WORDS)])
        yield batch_of(_leading(w, at), w.grams(n, _B2)[at], ids_of(part.column(0))[w.text[at]], w.start[at])
    tidy()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around the suffixes that are left: digest, document, first byte and end in one number."""
    for part in _slices(batches):
        w = Words(part.column(1))
        places = part.column(2)
        owner = np.repeat(np.arange(len(places)), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        left = (owner.astype(np.int64) << 40) | places.flatten().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(w.whole(MIN_WORDS))
        anchor = w.anchors()[first]
        first = first[np.isin((w.text[anchor].astype(np.int64) << 40) | w.start[anchor], left)]
        place = (w.start[first] << 32) | w.stop[first + MIN_WORDS - 1]
        yield batch_of(w.grams(MIN_WORDS, _B1)[first], w.grams(MIN_WORDS, _B2)[first], ids_of(part.column(0))[w.text[first]], place)
    tidy()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in (document, place) order to spans."""
    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, place, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        start, end = place >> 32, place & 0xFFFFFFFF
        if held is not None:
            doc, start, end, first = (np.r_[x, y] for x, y in zip(held, (doc, start, end, first)))
        # ends ascend with starts within a document, as every window has as many words
        new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])]
        at = np.flatnonzero(new)
        spans = (doc[at], start[at], np.maximum.reduceat(end, at), np.minimum.reduceat(first, at))
        held = tuple(x[-1:] for x in spans)
        if len(at) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in spans], ["doc", "start", "end", "first"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["doc", "start", "end", "first"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, first_doc_id): [start, end) in UTF-8 bytes of each span of repeated words that goes, and the smallest
    doc_id in which a part of it stands first. A null doc_id comes first of all."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    left = repeated(base.mapInArrow(_suffixes, ROWS), heads=True, places=False, name="suffixes").groupBy(F.col("doc").alias("k")).agg(F.collect_set("place").alias("places"))
    near = base.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).join(left, "k").select("doc_id", "text", "places")
    again = repeated(near.mapInArrow(_windows, ROWS), places=False, name="windows").select("doc", "place", F.col("first_doc").alias("first"))
    spans = again.repartition(n_parts(spark), "doc").sortWithinPartitions("doc", "place").mapInArrow(_merge, "doc long, start long, end long, first long")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return spans.select(null("doc").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), null("first").alias("first_doc_id"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: (doc_id, n_spans, n_bytes, spans), spans being what goes from its text, as repeats() has it.

    Texts under MIN_WORDS words, null, empty and blank ones have no spans. Rows with the same doc_id are one document: equal rows
    repeat nothing of each other. Empty tables give no rows.
    """
    key = F.coalesce("doc_id", F.lit(NO_ID))
    spans = cut(repeats(docs), "spans").groupBy(key.alias("k")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc_id"))).alias("spans"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("k", key).join(spans, "k", "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,first_doc_id:bigint>>)"))
    size = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return every.select("doc_id", F.size(spans).alias("n_spans"), size.alias("n_bytes"), spans.alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, the repeated spans cut from text, and n_chars, where docs has it, counted anew. Other columns, whatever their names, stay as they are."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    spans = cut(repeats(docs), "spans").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("k")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = packed(docs.withColumn("text", F.col("text").cast("string")), k=key).join(spans, "k", "left").select("row", "spans")
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, b.column(0).flatten()[text])):
            row, new = part.column(0), []
            columns = row.flatten()
            for t, s in zip(columns[text].cast(pa.binary()).to_pylist(), part.column(1).to_pylist()):
                if t is not None and s:
                    at, kept = 0, []
                    for x in s:
                        kept.append(t[at : x["start"]])
                        at = x["end"]
                    t = b"".join([*kept, t[at:]])
                new.append(t)
            columns[text] = pa.array(new, pa.binary()).cast(row.type.field(text).type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=[row.type.field(i) for i in range(len(columns))])], ["row"])
        tidy()

    out, new = rows.mapInArrow(run, rows.select("row").schema), F.col(f"row.c{text}")
    if "n_chars" not in docs.columns:
        return unpacked(out, docs.columns)
    old = F.col(f"row.c{docs.columns.index('n_chars')}")
    return unpacked(out, docs.columns, n_chars=F.when(new.isNotNull(), F.length(new)).otherwise(old).cast(docs.schema["n_chars"].dataType))
