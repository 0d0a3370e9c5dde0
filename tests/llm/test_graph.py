"""Links of vectors against all pairs, where groups are dense or cut into many shards."""

import numpy as np
from sparkseek.llm import graph
from sparkseek.llm.flatgraph import FlatGraph


def all_links(x, least=0.93):
    """(number of links of each vector, first vector of its component)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = x @ x.T >= least
    np.fill_diagonal(on, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(on, root[None, :], len(x)).min(axis=1))
        if (low == root).all():
            return on.sum(axis=1), root
        root = low


def held(spark, x):
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in graph.near_duplicates(df).collect()}
    n, root = all_links(x)
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert [got[i].kept for i in range(len(x))] == (root == np.arange(len(x))).tolist()


def subgroups(rng, d=64, each=50):
    """Two tight groups, cosine 0.99 within and 0.94 across, and others round a third direction, where the medoid is."""
    e = np.eye(d)
    ends = e[0], 0.949 * e[0] + np.sqrt(1 - 0.949**2) * e[1]
    tight = [c + rng.standard_normal((each, d)) * 0.07 / np.sqrt(d) for c in ends]
    return np.concatenate([*tight, e[2] + rng.standard_normal((300, d)) * 0.7 / np.sqrt(d)])


def test_tight_subgroups_are_linked_to_each_other(spark, monkeypatch):
    x = subgroups(np.random.default_rng(1))
    n, root = all_links(x)
    assert n[0] == 99 and root[:100].max() == 0
    for block in (3072, 60):
        monkeypatch.setattr(graph, "BLOCK", block)
        held(spark, x)


def test_all_links_over_many_shards(spark, monkeypatch):
    """Pairs that differ by as much as they may, round directions of no structure: their nearest centroids are seldom the same."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((400, 8))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([base, base * 0.932 + side * np.sqrt(1 - 0.932**2)])
    monkeypatch.setattr(graph, "SHARD", 20)
    for block in (3072, 100):
        monkeypatch.setattr(graph, "BLOCK", block)
        held(spark, x)


def test_the_graph_is_what_finds_links(spark, monkeypatch):
    """Without edges and beams nothing is found; nothing compares a shard behind them."""
    x = np.random.default_rng(4).standard_normal((300, 16))
    x[150:] = x[:150] + 0.01
    df = spark.createDataFrame([(i, v.tolist(), "a" if i % 2 else "b") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((y @ y.T >= 0.93) & ((np.arange(300)[:, None] - np.arange(300)) % 2 == 0)).sum(axis=1) - 1
    assert want.sum() > 100
    assert [r.n_links for r in graph.near_duplicates(df).orderBy("vec_id").collect()] == want.tolist()
    none = lambda ids, near: np.full((len(ids), 1), -1, np.int32)
    monkeypatch.setattr(graph, "local", none)
    monkeypatch.setattr(graph.FlatGraph, "search", lambda self, q, own=None: (np.full((len(q), 1), -1), np.full((len(q), 1), -1.0)))
    x, ids = y[:50], np.arange(50)
    found = graph.links(ids, x, np.ones(50, int), np.zeros(50, int), np.ones(50, bool), None, False, 0.1)
    assert not len(found[0])


def test_greedy_search_over_a_flat_graph():
    """Its beam holds the nearest of isotropic vectors with their near copies; every node is reached from the entries."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    x[2000:] = x[rng.integers(0, 40, 1000)] + 0.05 * rng.standard_normal((1000, 32))  # 40 tight groups
    x = graph.unit(x)
    g = FlatGraph(x)
    seen, new = np.zeros(3000, bool), g.entries
    while len(new):
        seen[new] = True
        new = np.unique(g.lists[new])
        new = new[(new >= 0) & ~seen[new]]
    assert seen.all() and (g.lists >= 0).sum(axis=1).min() >= 1
    ids, _ = g.search(g.x)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    near = np.argmax(s, axis=1)
    close = s.max(axis=1) > 0.93
    assert (ids == near[:, None]).any(axis=1)[close].mean() > 0.99


def test_most_common_length_counts(spark):
    rows = [(i, [1.0, 0.01 * i], 1) for i in range(5)] + [(10 + i, [1.0, 0.0, 0.0], 1) for i in range(3)]
    got = {r.vec_id: r.n_links for r in graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == 4 for i in range(5)) and all(got[10 + i] == 0 for i in range(3))
