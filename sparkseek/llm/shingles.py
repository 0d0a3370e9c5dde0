"""Near copies by exact similarity of word shingles.

Fingerprints that differ in two bits find texts that are almost the same. Texts that share four fifths of their five-word shingles
differ in about ten of 64 bits, which no index over runs of bits finds without comparing all; so candidates come from bands of
minima over the shingle digests (Broder, 1997), and each is verified by the exact share of common shingles.

Texts with equal shingle sets are one set from the start. A band value that several sets have is a bucket, and in a bucket each
set is compared with one leader: the set that meets most others over all its bands, which in a family of edited copies is the text
they were edited from. So a bucket gives as many pairs as it has sets, however many these are. Where that leaves sets of a bucket
in different groups, those of different groups are compared too: the bucket is cut by hash into blocks, each pair of blocks is one
task's work, a pair of sets is compared in the first band that both have, and links leave as a forest. So all pairs that meet in a
bucket are linked or verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spread import spread
from .common import components, cut, drop_cut, forest, tidy
from .suffixes import _B1, Words, _mix, _slices

WIDTH = 5
LEAST = 0.8
#: A set at similarity 0.8 shares one of the bands at least with a chance of 0.998.
BANDS, ROWS = 16, 5
#: Sets in a block of a bucket whose sets are compared with each other.
BLOCK = 512
_rng = np.random.default_rng(29)
_FACTOR, _SHIFT = (_rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(how many distinct shingles each text has, their digests text by text). Fewer words than width are one shingle, none are none."""
    w = Words(texts)
    words = np.bincount(w.text, minlength=len(texts))
    first = np.searchsorted(w.text, np.arange(len(texts)))
    ok = w.whole(width)
    owner, digest = [w.text[ok]], [w.grams(width, _B1)[ok]]
    for n in range(1, width):
        short = np.flatnonzero(words == n)
        if len(short):
            owner.append(short)
            digest.append(w.grams(n, _B1)[first[short]])
    owner, digest = np.concatenate(owner), np.concatenate(digest)
    order = np.lexsort((digest, owner))
    owner, digest = owner[order], digest[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
    return np.bincount(owner[new], minlength=len(texts)), digest[new]


def bands_of(digest: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band values of sets of digests that begin at starts: one row a set."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(starts), b, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(digest * _FACTOR[r] + _SHIFT[r], starts))
        out[:, b] = value
    return out


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        count, digest = shingle_sets(part.column(1), width)
        some = np.flatnonzero(count)
        edges = np.r_[0, np.cumsum(count[some])]
        if not len(some):
            continue
        hi, lo = (_mix(np.add.reduceat(_mix(digest ^ np.uint64(s)), edges[:-1])) for s in (0x51ED270B, 0xA24BAED4))
        bands = bands_of(digest, edges[:-1]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(some)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(count[some].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((digest >> np.uint64(32)).astype(np.uint32).view(np.int32))),
            ],
            ["doc", "hi", "lo", "n", "bands", "digests"],
        )
    tidy()


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets share enough: common / all >= least."""
    for batch in batches:
        (x, p), (y, q) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(2), batch.column(3)))
        a, b = [], []
        for i, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            both = np.sort(np.r_[x[p[i] : p[i + 1]], y[q[i] : q[i + 1]]])
            common = int((both[1:] == both[:-1]).sum())
            if common >= least * (len(both) - common):
                a.append(u)
                b.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    tidy()


def _cross(key: tuple, table: pa.Table, least: float) -> pa.Table:
    """Links between sets of different groups in one pair of blocks of a bucket: (a, b), a forest."""
    t = table.combine_chunks()
    band, across = key[0].as_py(), key[1].as_py() != key[2].as_py()
    doc, part = t.column("doc").to_numpy(), t.column("part").to_numpy()
    group = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
    lists = t.column("digests").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    values, word = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    starts = np.r_[0, np.cumsum(n)]
    mark, b, e = np.zeros(len(values), bool), [], []
    for i in range(len(doc) - 1):
        j = np.arange(i + 1, len(doc))
        j = j[(group[j] != group[i]) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))]
        if across:
            j = j[part[j] != part[i]]
        if len(j):  # in no earlier band
            j = j[bands[j, (bands[j] == bands[i]).argmax(axis=1)] == band]
        if not len(j):
            continue
        mine = word[starts[i] : starts[i + 1]]
        mark[mine] = True
        edges = np.r_[0, np.cumsum(n[j])]
        at = np.arange(edges[-1]) + np.repeat(starts[j] - edges[:-1], n[j])
        common = np.add.reduceat(mark[word[at]].astype(np.int64), edges[:-1])
        mark[mine] = False
        for k in j[common >= least * (n[i] + n[j] - common)]:
            b.append(doc[i])
            e.append(doc[k])
            group[group == group[k]] = group[i]
    x, y = forest(np.array(b, np.int64), np.array(e, np.int64))
    return pa.table({"a": x, "b": y})


def unlike(members: DataFrame, heads: DataFrame, sets: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of sets that share a bucket and that `links` leave in different groups."""
    again = lambda df, c: df.withColumn("j", F.col(c).bitwiseXOR(F.lit(1))).drop(c)  # noqa: E731  dealt anew, so that hot keys can be split
    roots = components(links).select(F.col("node").alias("head"), "root")
    grouped = again(members, "head").join(again(roots, "head"), "j", "left").select("band", F.col("j").bitwiseXOR(F.lit(1)).alias("head"), "size", F.coalesce("root", F.col("j").bitwiseXOR(F.lit(1))).alias("root"))
    grouped = cut(grouped, "grouped")
    # two sets alone were compared when one led the other
    mixed = grouped.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    mixed = again(grouped.filter("size > 2"), "band").join(again(mixed, "band"), "j").select(F.col("j").bitwiseXOR(F.lit(1)).alias("band"), "head", "size", "root")
    mixed = cut(mixed, "mixed")
    texts = again(sets.select("doc", "hi", "lo", "digests"), "doc").join(again(mixed.select(F.col("head").alias("doc")).distinct(), "doc"), "j", "left_semi").dropDuplicates(["j"])
    texts = cut(texts.join(again(heads.select("head", "bands"), "head"), "j").select("j", "bands", "digests"), "mixed-sets")
    dealt = again(mixed, "head").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("j"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("x", F.least("part", "with")).withColumn("y", F.greatest("part", "with"))
    dealt = dealt.join(texts, "j").select("band", "x", "y", F.col("j").bitwiseXOR(F.lit(1)).alias("doc"), "root", "part", "bands", "digests")
    found = cut(dealt.groupBy("band", "x", "y").applyInArrow(lambda key, table: _cross(key, table, least), "a long, b long"), "unlike")
    drop_cut(grouped, mixed, texts)
    return found


def near_copies(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) of ids whose texts have equal shingle sets or, found and verified, share `least` of their shingles or more.

    Links are those to the first of equal sets, to leaders, and a forest of the rest, not all pairs. Null, empty and blank texts have no shingles and no
    links; ids must not be null. Rows that repeat an id add nothing. Empty tables give no rows.
    """
    again = lambda df, c: df.withColumn("j", F.col(c).bitwiseXOR(F.lit(1))).drop(c)  # noqa: E731  dealt anew, so that hot keys can be split
    base = spread(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")))
    sets = cut(base.mapInArrow(lambda it: _sketches(it, width), "doc long, hi long, lo long, n int, bands array<long>, digests array<int>"), "sketches")
    heads = cut(sets.groupBy("hi", "lo").agg(F.min("doc").alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    equal = again(sets.select("doc", "hi", "lo"), "hi").join(again(heads.select("hi", "lo", "head"), "hi"), ["j", "lo"]).filter("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b"))
    keys = heads.select("hi", "head", "n", F.explode("bands").alias("band"))
    full = keys.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(again(keys, "band").join(again(full, "band"), "j").select(F.col("j").bitwiseXOR(F.lit(1)).alias("band"), "hi", "head", "n", "size"), "members")
    meets = members.groupBy("hi").agg(F.sum("size").alias("meets"))
    ranked = again(members, "hi").join(again(meets, "hi"), "j").select("band", F.struct("meets", F.col("j").bitwiseXOR(F.lit(1)).alias("hi"), "head", "n").alias("r"))
    leaders = ranked.groupBy("band").agg(F.max("r").alias("r")).select("band", F.col("r.hi").alias("hi_b"), F.col("r.head").alias("b"), F.col("r.n").alias("n_b"))
    met = again(members, "band").join(again(leaders, "band"), "j").filter("hi <> hi_b")
    pairs = met.filter(F.least("n", "n_b") >= least * F.greatest("n", "n_b")).select("hi", F.col("head").alias("a"), "hi_b", "b").distinct()
    pairs = cut(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("hi", "hi_b")).alias("hi")).distinct()
    first = heads.join(wanted, "hi", "left_semi").select("hi", F.col("head").alias("doc"))
    whole = cut(sets.select("doc", "hi", "digests").join(first, ["doc", "hi"], "left_semi").dropDuplicates(["hi"]), "digests")
    both = pairs.join(whole.select("hi", F.col("digests").alias("x")), "hi").select("a", "b", "hi_b", "x")
    both = both.join(whole.select(F.col("hi").alias("hi_b"), F.col("digests").alias("y")), "hi_b").select("a", "b", "x", "y")
    found = cut(equal.unionByName(both.mapInArrow(lambda it: _verify(it, least), "a long, b long")), "near-copies")
    drop_cut(pairs, whole)
    rest = unlike(members, heads, sets, found, least)
    drop_cut(sets, heads, members)
    return found.unionByName(rest)


def recall(docs: DataFrame, groups: DataFrame, least: float = LEAST, width: int = WIDTH, queries: int = 256, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, int]:
    """Audit: of the pairs that share `least` of their shingles the share that `groups` (node, root) has in one group, and how many pairs that is of.

    A bounded number of documents is compared with all rows by brute force: the first by hash, and as many of those in groups.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    some = lambda df: df.orderBy(F.xxhash64("doc")).limit(queries)
    picked = some(base).unionByName(some(base.join(groups.select(F.col("node").alias("doc")), "doc", "left_semi"))).dropDuplicates(["doc"]).collect()
    ids = np.array([r.doc for r in picked], np.int64)
    size, digest = shingle_sets(pa.array([r.text for r in picked], pa.string()), width)
    order = np.argsort(digest, kind="stable")
    table, owner = digest[order], np.repeat(np.arange(len(ids)), size)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(iter([batch])):
                n, d = shingle_sets(part.column(1), width)
                lo, hi = np.searchsorted(table, d, "left"), np.searchsorted(table, d, "right")
                at = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                row = np.repeat(np.repeat(np.arange(len(n)), n), hi - lo)
                common = np.bincount(row * len(ids) + owner[at], minlength=len(n) * len(ids)).reshape(len(n), len(ids))
                doc = part.column(0).to_numpy()
                i, j = np.nonzero((common > 0) & (common >= least * (n[:, None] + size[None, :] - common)) & (doc[:, None] != ids[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(doc[i])], ["a", "b"])
        tidy()

    true = base.mapInArrow(run, "a long, b long").distinct()
    of = lambda c, s: groups.select(F.col("node").alias(c), F.col("root").alias(f"root_{s}"))
    both = true.join(of("a", "a"), "a", "left").join(of("b", "b"), "b", "left").agg(F.count_if(F.col("root_a") == F.col("root_b")), F.count("*")).first()
    return (both[0] / both[1] if both[1] else 1.0), both[1]
