"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are found row by row. Distinct fingerprints are then indexed: with k allowed differences, the 64 bits are cut into
k + 1 runs of bits; two fingerprints at k or fewer differences agree in one run at least. For each run the bits are rotated so
that it leads, and the codes are sorted by Gray rank, where codes that share leading bits stand together. Over the codes that
agree in a run stands a hierarchy in that order: leaves of LEAF codes at most, upper nodes of FAN leaves, top nodes of FAN upper
nodes. Each has the mask of the bits in which all its codes agree and the pattern of those bits.

Two top nodes of a run's value are compared in the bits that both masks have; beyond k differences everything below them is
left out. What stays goes down a level: children's masks have more bits, of which those not seen above are compared and the
differences accumulate; and so to the leaves, whose codes are compared one by one. Nodes carry two numbers and are paired by their
own ids, so that a run's value with very many codes is spread over tasks at every level. Leaves are cut from range partitions of
the sorted codes, so that no value, however many codes it has, is gathered in one task. Links are reduced to a forest within
each batch before they leave a task, so that dense groups do not emit all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spread import spread
from .common import components, cut, forest, n_parts, packed, tidy, unpacked
from .shingles import LEAST, WIDTH, near_copies

LEAF = 256
FAN = 32
LEVELS = 3
_STEP = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of one text: a bit is set if over half the width-word shingles' XXH64 values (seed 42) have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    digest, counts, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _STEP):  # big-endian digests, so that unpacked bits run from the highest to the lowest
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                fps = np.fromiter((fingerprint(t or b"", width) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        tidy()

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, fp long")


def _gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _runs(k: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each of k + 1 runs of bits."""
    edge = [64 * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _turn(code: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return code if by == 0 else (code << np.uint64(by)) | (code >> np.uint64(64 - by))


_SIGN = np.uint64(1 << 63)


def _ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each code once for each run of bits: (run, Gray rank of the rotated code in signed order)."""
    for batch in batches:
        code = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i, (at, _) in enumerate(_runs(k)):
            rank = (_gray_rank(_turn(code, at)) ^ _SIGN).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)), pa.array(rank)], ["run", "rank"])


def _close(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= k)
    return x[i], y[j]


def _within(code: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between codes of the same leaf; leaf numbers ascend."""
    a, b = [], []
    for d in range(1, LEAF):
        near = np.flatnonzero(leaf[d:] == leaf[:-d]) if d < len(leaf) else np.empty(0, int)
        if not len(near):
            break
        near = near[np.bitwise_count(code[near] ^ code[near + d]) <= k]
        a.append(code[near])
        b.append(code[near + d])
    return forest(np.concatenate(a), np.concatenate(b)) if a else (code[:0], code[:0])


_LEAVES = "a long, b long, level int, run int, node long, id long, parent long, mask long, pattern long, codes binary"
_TYPES = [("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("run", pa.int32()), ("node", pa.int64()), ("id", pa.int64()), ("parent", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("codes", pa.binary())]


def _rows(**columns) -> pa.RecordBatch:
    """Rows of _LEAVES, null where a column is not given."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES], schema=pa.schema(_TYPES))


def _cut_leaves(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """From one partition in (run, rank) order: links within leaves, and the leaves of values that may have another leaf, with the
    nodes above them."""
    widths, turns = np.array([w for _, w in _runs(k)]), [at for at, _ in _runs(k)]
    made = TaskContext.get().partitionId() << 40  # ids go on from here

    def out(run: np.ndarray, rank: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        gray = rank.view(np.uint64) ^ _SIGN
        gray = gray ^ (gray >> np.uint64(1))  # rank back to the rotated code
        node = gray >> (64 - widths[run]).astype(np.uint64)
        new = np.r_[True, (run[1:] != run[:-1]) | (node[1:] != node[:-1])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(run)])
        which = np.repeat(np.arange(len(start)), size)
        offset = np.arange(len(run)) - start[which]
        leaf = np.cumsum(np.r_[True, new[1:] | (offset[1:] % LEAF == 0)]) - 1
        code = np.empty_like(gray)
        for i, at in enumerate(turns):
            code[run == i] = _turn(gray[run == i], 64 - at)
        a, b = _within(code, leaf, k)
        if len(a):
            yield _rows(a=a.view(np.int64), b=b.view(np.int64))
        many = size > LEAF
        many[0] |= first
        many[-1] |= last
        keep = np.flatnonzero(many[which])
        if not len(keep):
            return
        run, node, which, offset, code = run[keep], node[keep], which[keep], offset[keep], code[keep]
        below = None
        for level in reversed(range(LEVELS)):
            span = LEAF * FAN**level
            heads = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (offset[1:] // span != offset[:-1] // span)])
            ids = made + np.arange(len(heads))
            made += len(heads)
            high, low = np.bitwise_or.reduceat(code, heads), np.bitwise_and.reduceat(code, heads)
            mask = ~(high ^ low)
            columns = {"level": np.full(len(heads), level), "run": run[heads], "node": node[heads].view(np.int64), "id": ids, "mask": mask.view(np.int64), "pattern": (low & mask).view(np.int64)}
            if below is not None:
                columns["parent"] = below[heads]
            if level == 0:
                columns["codes"] = [code[s:e].tobytes() for s, e in zip(heads, np.r_[heads[1:], len(code)])]
            yield _rows(**columns)
            below = np.repeat(ids, np.diff(np.r_[heads, len(code)]))

    run, rank, first = np.empty(0, np.int32), np.empty(0, np.int64), True
    for batch in batches:
        run = np.concatenate([run, batch.column(0).to_numpy(zero_copy_only=False)])
        rank = np.concatenate([rank, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(run) > 4 * _STEP:  # all but the open value go now; a value longer than that goes in pieces that are compared as nodes
            gray = rank.view(np.uint64) ^ _SIGN
            node = (gray ^ (gray >> np.uint64(1))) >> (64 - widths[run]).astype(np.uint64)
            at = np.flatnonzero((run != run[-1]) | (node != node[-1]))
            stop = int(at[-1]) + 1 if len(at) else len(run)
            yield from out(run[:stop], rank[:stop], first, stop == len(run))
            first = stop == len(run)
            run, rank = run[stop:], rank[stop:]
    if len(run):
        yield from out(run, rank, first, True)
    tidy()


def _across(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Links between the codes of two leaves."""
    for batch in batches:
        a, b = [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            i, j = forest(*_close(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), k))
            a.append(i)
            b.append(j)
        if a:
            a, b = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def linked(codes: DataFrame, k: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct codes (fp long) at k or fewer differing bits."""
    spark = codes.sparkSession
    ranked = codes.select("fp").mapInArrow(lambda it: _ranked(it, k), "run int, rank long")
    ordered = ranked.repartitionByRange(n_parts(spark), "run", "rank").sortWithinPartitions("run", "rank")
    found = cut(ordered.mapInArrow(lambda it: _cut_leaves(it, k), _LEAVES), "leaves")
    pairs = None
    for level in reversed(range(LEVELS)):
        nodes = found.filter(F.col("level") == level)
        x, y = (nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("run", "node", "id", "parent", "mask", "pattern"))) for s in "xy")
        if pairs is None:
            both = x.join(y, (F.col("run_x") == F.col("run_y")) & (F.col("node_x") == F.col("node_y"))).withColumn("seen", F.lit(0).cast("long")).withColumn("diff", F.lit(0))
        else:
            both = pairs.join(x, "parent_x").join(y, "parent_y")
        common = F.col("mask_x").bitwiseAND(F.col("mask_y"))
        fresh = common.bitwiseAND(F.bitwise_not("seen"))
        diff = F.col("diff") + F.bit_count(F.col("pattern_x").bitwiseXOR(F.col("pattern_y")).bitwiseAND(fresh))
        order = F.col("id_x") <= F.col("id_y") if level else F.col("id_x") < F.col("id_y")
        pairs = both.filter(order).select(F.col("id_x").alias("parent_x"), F.col("id_y").alias("parent_y"), common.alias("seen"), diff.alias("diff")).filter(F.col("diff") <= k)
    x, y = (found.filter("level = 0").select(F.col("id").alias(f"parent_{s}"), F.col("codes").alias(f"codes_{s}")) for s in "xy")
    near = pairs.select("parent_x", "parent_y").join(x, "parent_x").join(y, "parent_y").select("codes_x", "codes_y")
    return found.filter("level is null").select("a", "b").unionByName(near.mapInArrow(lambda it: _across(it, k), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, fp long, component_id long).

    Documents are linked if their fingerprints differ in k or fewer of 64 bits; component_id is the smallest doc_id reachable.
    Null, empty and blank texts have fingerprint 0 and are linked like any other. A null doc_id never becomes a component_id
    unless all of the component's ids are null. Repeated rows come out as often as they came in. Empty tables give no rows.
    """
    found = cut(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("head")), "codes")
    roots = components(linked(nodes, k)).select(F.col("node").alias("fp"), "root")
    of = nodes.join(roots, "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("head").alias("component_id"))
    by_code = cut(of.join(least, "root").select("fp", "component_id"), "components")
    return found.join(by_code, "fp").select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, k: int = 2, width: int = 3, least: float = LEAST, words: int = WIDTH, id_col: str = "doc_id") -> DataFrame:
    """(node, root) of each document in a group with others: connected by fingerprints that differ in k or fewer bits and by texts that share `least` of
    their shingles of so many words. root is the smallest id of the group. Ids must not be null; documents alone are not in the result."""
    same = near_duplicates(docs, k, width, id_col=id_col).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    found = components(same.filter("a <> b").unionByName(near_copies(docs, least, words, id_col=id_col)))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def keep_one(docs: DataFrame, k: int = 2, width: int = 3, least: float = LEAST, words: int = WIDTH) -> DataFrame:
    """docs without near duplicates, in the columns of docs: the row of each group that has its smallest doc_id.

    A group is connected by fingerprints that differ in k or fewer bits and by texts that share `least` of their shingles of so
    many words. Null, empty and blank texts are one group. Of rows that repeat a doc_id one stays, the first by hash of its text. A
    row with a null doc_id is known by its text and stays only if its group has no row with an id; of such rows with equal texts
    one stays. Other columns, whatever their names, are carried along. Empty tables give no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("text"), 2)))
    rows = packed(docs, k=key, text=F.col("text"))
    gone = cut(near_groups(rows.select("k", "text"), k, width, least, words, "k").filter("node <> root").select(F.col("node").alias("k")), "gone")
    one = rows.groupBy("k").agg(F.min_by("row", F.struct(F.xxhash64("text"), F.length("text"))).alias("row"))
    return unpacked(one.join(gone, "k", "left_anti"), docs.columns)
