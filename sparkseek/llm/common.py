"""Shared pieces of the training-data operators: cutting lineage, digests, local forests and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, own_folder

#: White space of every word rule in this subpackage.
SPACE = r"\x20\x09-\x0D"


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: What a worker keeps of a task for the next ones of its kind, such as a model; a task of another kind drops it when it ends.
remembered: dict = {}


def tidy(keep: bool = False) -> None:
    """At the end of a task, give what it has freed back to the system: workers are used again and would keep their largest size.

    keep: the task is of the kind that `remembered` is for, which else goes as well."""
    if not keep:
        remembered.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lost executors cannot force the work before it again.

    Tables stand in a folder of the application, which goes when the driver ends, if drop_cut() has not deleted them before.
    """
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables written by cut() that no later step reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)


def slices(batch: pa.RecordBatch, texts: pa.Array, rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of so many rows, and so many bytes of texts, at most; a longer text is a piece of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column `row`, fields c0, c1, ... by position, beside the columns of `more`: whatever names docs has, none meets those of an operator."""
    fields = [docs[f"`{c.replace('`', '``')}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.struct(*fields).alias("row"), *(c.alias(n) for n, c in more.items()))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of packed() again, those in `new` replaced."""
    return rows.select(*(new.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(rows: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """n rows at most, the first by hash of key: a sample for fitting.

    All but about twice n rows are left out where they are read, by their hash alone, so that what meets in one place is bounded
    by n and does not grow with the number of tasks.
    """
    there = rows.count()
    low = F.shiftrightunsigned(F.xxhash64(key), 1) / F.lit(float(1 << 63))  # even in [0, 1)
    some = rows if there <= 2 * n else rows.filter(low < min(1.0, (2 * n + 100) / there))
    return some.orderBy(F.xxhash64(key), key, *ties).limit(n)


def n_words(text: Column) -> Column:
    """Number of maximal runs of [^\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that join the same nodes as the edges (a, b), self-edges left out."""
    if not len(a):
        return a[:0], b[:0]
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(ids))
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, lab[x], low)
        np.minimum.at(new, lab[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    keep = lab != np.arange(len(ids))
    return ids[keep], ids[lab[keep]]


def _least(e: DataFrame) -> DataFrame:
    """Each a with the least of itself and its partners b; keyed by k, so that a join deals it out anew and can split hot keys."""
    m = e.groupBy("a").agg(F.min("b").alias("m"))
    return m.select(F.col("a").bitwiseXOR(F.lit(1)).alias("k"), F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a long, b long): rows (node, root), root the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014); rounds grow with the logarithm of the longest path. Each
    step pre-aggregates a minimum and joins it back with splittable exchanges, so that no hub is gathered in one task, and each
    round is cut through the shared folder. Nodes without a link to another node are not in the result.
    """
    cur = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.filter("b > a").withColumn("k", F.col("a").bitwiseXOR(F.lit(1))).join(_least(both), "k").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.withColumn("k", F.col("a").bitwiseXOR(F.lit(1))).join(_least(large), "k")
        moved = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        new = cut(moved, "edges")
        now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_cut(cur)
        cur = new
        if now == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
