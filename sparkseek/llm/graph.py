"""Embedding near-dedup over a robust-pruned flat graph.

1. Clusters. Within a label, each vector is at home in the shard of its nearest centroid, of those fitted on a bounded sample, and
   visits every other shard in which a partner at the threshold could be at home: unit vectors u and v at cosine t are
   r = sqrt(2 - 2 t) apart, and if v is nearer to centroid c than to u's own centroid h, then u (h - c) <= r |h - c|. So shards
   overlap, and both of a pair meet in the home of each.
2. Building. In each shard a flat graph grows by greedy inserts with robust pruning (flatgraph.py), visitors included.
3. Union. The adjacency lists of a vector from all its shards become one.
4. Search. In its home shard each vector is searched for over the united lists, greedily from the shard's medoid and its own node. From what the
   beam holds within SLACK of the threshold the search expands along edges that are as near. Queries whose ranges touch share the
   expansion, so that a dense group is walked once. A beam that is full within the range is widened to the whole shard.
5. Verification. What a range reached is compared in double precision; links are counted for vectors at home only, once each.
   recall() audits the result against all rows.

Equal vectors of a label are one from the start, with a number of copies, so that a very common one costs no more than any other.
A shard with over BLOCK members, such as one dense group, is cut by hash into blocks with a graph each, and each pair of blocks is
compared as it is. Links leave a group as a count for each vector and a forest, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest
from .flatgraph import FlatGraph
from .vectors import kept_type, length_of, matrix, sample_of, usable

#: Vectors that centroids are fitted on: so many for each, and so many at most.
PER_CENTROID, SAMPLE = 16, 65_536
#: Vectors at home in a shard, about; members of a block at most, about. A search costs little more in a larger shard, and fewer shards have fewer copies.
SHARD = 16_384
BLOCK = 32_768
SLACK = 0.05
#: Far above the rounding of a cosine.
EPS = 1e-9


def centroids(sample: list, n: int) -> dict[str, np.ndarray]:
    """Unit centroids of each label of the sample, about one for SHARD of the n vectors; spherical k-means."""
    found: dict[str, list] = {}
    for label, v in sample:
        found.setdefault(label, []).append(v)
    out = {}
    for label, vs in found.items():
        x = unit(np.array(vs, float))
        k = int(min(max(1, round(n * len(x) / len(sample) / SHARD)), max(1, len(x) // PER_CENTROID)))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(8):
            near = np.concatenate([np.argmax(x[at : at + 4096] @ c.T, axis=1) for at in range(0, len(x), 4096)])
            order = np.argsort(near, kind="stable")
            some, begin = np.unique(near[order], return_index=True)
            mean = np.add.reduceat(x[order], begin, axis=0)
            length = np.linalg.norm(mean, axis=1, keepdims=True)
            c[some] = np.where(length > 0, mean / np.where(length > 0, length, 1), c[some])
        out[label] = c
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each unit vector, whether it must be in each shard): all shards in which a vector at `least` may be at home."""
    s = x @ c.T
    home = np.argmax(s, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))  # of unit centroids
    return home, s[np.arange(len(x)), home][:, None] - s <= np.sqrt(max(0.0, 2 - 2 * least)) * apart + 1e-6  # far above rounding


def steps(rows: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """rows in pieces whose products with n columns stay small."""
    size = max(1, (1 << 22) // max(1, n))
    return (rows[at : at + size] for at in range(0, len(rows), size))


def local(ids: np.ndarray, near: pa.ListArray) -> np.ndarray:
    """United lists as row numbers, -1 to fill up; neighbours that are not here are left out."""
    size = near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner, to = np.repeat(np.arange(len(ids)), size), near.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, to, sorter=order), len(ids) - 1)
    here = ids[order[at]] == to
    owner, to = owner[here], order[at][here]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.full((len(ids), int(rank.max(initial=0)) + 1), -1, np.int32)
    out[owner, rank] = to
    return out


def expanded(x: np.ndarray, lists: np.ndarray, home: np.ndarray, least: float) -> np.ndarray:
    """A number for each vector: what the ranges of vectors at home have reached together has the same."""
    graph = FlatGraph(x, lists)
    a, b = np.repeat(np.arange(len(x)), lists.shape[1]), lists.ravel()
    a, b = a[b >= 0], b[b >= 0]
    near = np.concatenate([np.einsum("ij,ij->i", x[a[at : at + 65_536]], x[b[at : at + 65_536]]) >= least - SLACK for at in range(0, len(a), 65_536)] or [np.zeros(0, bool)])
    edges, queries = [(a[near], b[near])], np.flatnonzero(home)
    for at in range(0, len(queries), 512):
        i = queries[at : at + 512]
        found, sim = graph.search(graph.x[i], i)
        within = (found >= 0) & (sim >= least - SLACK)
        p, q = np.nonzero(within)
        edges.append((i[p], found[p, q]))
        for i in steps(i[within.all(axis=1)], len(x)):
            p, q = np.nonzero(x[i] @ x.T >= least - EPS)
            edges.append(forest(i[p], q))
    node, root = forest(*(np.concatenate(e) for e in zip(*edges)))
    group = np.arange(len(x))
    group[node] = root
    return group


def links(ids: np.ndarray, x: np.ndarray, copies: np.ndarray, part: np.ndarray, home: np.ndarray, near: pa.ListArray, across: bool, least: float):
    """(ids with links, how many count here, roots): links of one group; each vector stands for so many copies. Visitors get no count."""
    count, ea, eb = np.zeros(len(ids), np.int64), [], []

    def verify(rows: np.ndarray, cols: np.ndarray) -> None:
        """All pairs of rows with cols; they count for rows at home."""
        for i in steps(rows, len(cols)):
            on = x[i] @ x[cols].T >= least
            on &= i[:, None] != cols[None, :]
            count[i] += (on @ copies[cols]) * home[i]
            p, q = np.nonzero(on)
            p, q = forest(i[p], cols[q])
            ea.append(p)
            eb.append(q)

    if across:
        lo = part == part.min()
        for here, there in ((lo, ~lo), (~lo, lo)):
            verify(np.flatnonzero(here & home), np.flatnonzero(there))
    else:
        group = expanded(x, local(ids, near), home, least)
        order = np.argsort(group, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        for lo, hi in zip(begin, np.r_[begin[1:], len(ids)]):
            some = order[lo:hi]
            if hi - lo > 1:
                verify(some[home[some]], some)
    a, b = forest(np.concatenate(ea), np.concatenate(eb)) if ea else (np.zeros(0, int), np.zeros(0, int))
    head = ids.copy()
    head[a] = ids[b]
    some = np.flatnonzero((count > 0) | (head != ids))
    return ids[some], count[some], head[some]


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors are linked if their labels, of any type, are equal and not null and their cosine is `least` or more. Null vectors, zero
    ones, those with null or non-finite components, or of another length than most, link with nothing. Rows that repeat a
    vec_id are one vector, the first by hash of its content. Rows with a null vec_id have no links, a null component and are not
    kept. Empty tables give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), kept_type(vectors, vector_col).alias("v"))
    once = rows.filter("vec_id is not null").groupBy("vec_id").agg(F.min_by(F.struct("label", "v"), F.xxhash64("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    once = cut(once, "vectors")
    good = once.filter(usable(F.col("v")) & F.col("label").isNotNull()).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    key = ["label", "h1", "h2"]
    sets = cut(good.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v")), "sets")
    every = once.select("vec_id").unionByName(rows.filter("vec_id is null").select("vec_id"))
    d = length_of(sets)
    if d is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    alike = sets.filter(F.size("v") == d)
    n = alike.count()
    of = centroids([(r.label, r.v) for r in sample_of(alike, min(SAMPLE, max(4096, PER_CENTROID * -(-n // SHARD))), "label", "v")], n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its shards."""
        for batch in batches:
            x, label = unit(matrix(batch.column(2))) if batch.num_rows else np.zeros((0, d)), np.array(batch.column(1).to_pylist(), object)
            for l in np.unique(label):
                c, own = of.get(l), np.flatnonzero(label == l)
                for lo in range(0, len(own), 256):
                    at = own[lo : lo + 256]
                    home, there = reach(x[at], c, least) if c is not None else (np.zeros(len(at), int), np.ones((len(at), 1), bool))
                    i, shard = np.nonzero(there)
                    for k in range(0, len(i), 8192):
                        row, to = i[k : k + 8192], shard[k : k + 8192]
                        rows = pa.array(at[row])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(to.astype(np.int32)), pa.array(home[row] == to), batch.column(2).take(rows), batch.column(3).take(rows)], ["vec_id", "label", "shard", "home", "v", "copies"])

    kind = sets.schema["v"].dataType.simpleString()
    placed = cut(alike.select("vec_id", "label", "v", "copies").mapInArrow(place, f"vec_id long, label string, shard int, home boolean, v {kind}, copies long"), "placed")
    sizes = placed.groupBy("label", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("home").alias("any")).filter("any").drop("any")
    keyed = lambda df: df.withColumn("k", F.xxhash64("label", "shard")).withColumnRenamed("label", "l").withColumnRenamed("shard", "s")  # noqa: E731  dealt anew, so that hot shards can be split
    dealt = keyed(placed).join(keyed(sizes), ["k", "l", "s"]).withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)"))

    def build(table: pa.Table) -> pa.Table:
        """The lists of one block's graph."""
        t = table.combine_chunks()
        ids = t.column("vec_id").to_numpy()
        to = FlatGraph(unit(matrix(t.column("v").combine_chunks()))).lists
        edges = np.r_[0, np.cumsum((to >= 0).sum(axis=1))].astype(np.int32)
        return pa.table({"vec_id": ids, "near": pa.ListArray.from_arrays(pa.array(edges), pa.array(ids[to[to >= 0]]))})

    lists = dealt.select("l", "s", "part", "vec_id", "v").groupBy("l", "s", "part").applyInArrow(build, "vec_id long, near array<long>")
    lists = cut(lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")  # one list a shard of the vector
    dealt = dealt.join(lists, "vec_id").withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("lo", F.least("part", "with")).withColumn("hi", F.greatest("part", "with"))
    dealt = dealt.select("l", "s", "lo", "hi", "vec_id", "part", "home", "v", "copies", F.when(F.col("lo") == F.col("hi"), F.col("near")).alias("near"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        column = lambda c: t.column(c).combine_chunks()
        found = links(column("vec_id").to_numpy(), unit(matrix(column("v"))), column("copies").to_numpy(), column("part").to_numpy(), column("home").to_numpy(zero_copy_only=False), column("near"), key[2].as_py() != key[3].as_py(), least)
        return pa.table([pa.array(f) for f in found], names=["vec_id", "n", "root"])

    found = cut(dealt.groupBy("l", "s", "lo", "hi").applyInArrow(run, "vec_id long, n long, root long"), "links")
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec_id"), "root")
    n = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    # what holds for one vector of a set of copies holds for all, and each has links to the others
    of_set = sets.join(n, "vec_id", "left").join(roots, "vec_id", "left")
    same = F.when(F.size("v") == d, F.col("copies") - 1).otherwise(0)
    of_set = of_set.select(*key, (F.coalesce("n", F.lit(0)) + same).alias("n"), F.when(F.size("v") == d, F.coalesce("root", "vec_id")).alias("root"))
    again = lambda df: df.withColumn("j", F.col("h1").bitwiseXOR(F.lit(1))).drop("h1")  # noqa: E731  dealt anew, so that a very common vector can be split
    linked = again(good.select("vec_id", *key)).join(again(of_set), ["j", "label", "h2"]).select("vec_id", "n", "root")
    out = every.join(linked, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def recall(vectors: DataFrame, found: DataFrame, least: float = 0.93, queries: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Audit: the share of a bounded number of vectors' true links that found's n_links has, by comparing those with all rows.

    The vectors audited are the first by hash that have a link by either count, so that the figure is about links. Vectors of
    another length than most of them are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"])
    picked = rows.join(found.filter("n_links > 0").select("vec_id"), "vec_id", "left_semi").orderBy(F.xxhash64("vec_id")).limit(queries).unionByName(rows.orderBy(F.xxhash64("vec_id", F.lit(2))).limit(queries)).dropDuplicates(["vec_id"]).collect()
    if not picked:
        return 1.0
    sizes = [len(r.v) for r in picked]
    d = max(set(sizes), key=sizes.count)
    picked, rows = [r for r in picked if len(r.v) == d], rows.filter(F.size("v") == d)
    q = np.array([r.v for r in picked])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, labels = np.array([r.vec_id for r in picked]), np.array([r.label for r in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                on = (q @ x.T >= least) & (labels[:, None] == np.array(batch.column(1).to_pylist())[None, :]) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                total += on.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

    true = rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    both = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return float(both[0] / both[1]) if both[1] else 1.0
