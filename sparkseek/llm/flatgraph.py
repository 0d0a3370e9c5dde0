"""A flat graph over unit vectors that fit in memory: greedy inserts in batches, robust pruning, beam search from the medoid.

Each batch searches the graph of those before it from the medoid; what a vector's beam holds, and its nearest in the batch, are its
candidates, of which robust pruning keeps those to which no kept one is nearer by the factor ALPHA (Subramanya et al., 2019). Edges
count in both directions; a list that overflows is pruned again. Batches double, so that the first ones find a graph. Pruning may
leave a tight group with no edge from outside; such a part gets an entry of its own, where searches begin beside the medoid. All
steps are matrix operations over a batch.
"""

from __future__ import annotations

import numpy as np

from .common import forest

DEGREE = 16
BEAM = 64
#: Nodes of a beam that are expanded at once.
WIDE = 4
ALPHA = 1.2
FIRST, BATCH = 64, 512


def _nearest(cand: np.ndarray, sim: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if cand.shape[1] <= n:
        return cand, sim
    top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
    return np.take_along_axis(cand, top, 1), np.take_along_axis(sim, top, 1)


def pruned(x: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Lists of DEGREE at most of each row's candidates, -1 where there are fewer; candidates of similarity -inf are none."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    out, rows, alive = np.full((len(cand), DEGREE), -1, np.int32), np.arange(len(cand)), np.isfinite(sim)
    v = x[np.maximum(cand, 0)]
    between = v @ v.transpose(0, 2, 1)
    for k in range(min(DEGREE, cand.shape[1])):
        pick = np.argmax(alive, axis=1)
        have = alive[rows, pick]
        if not have.any():
            break
        out[have, k] = cand[have, pick[have]]
        alive[rows, pick] = False
        alive &= ~(have[:, None] & (ALPHA * (1 - between[rows, pick]) <= 1 - sim))
    return out


class FlatGraph:
    """Vectors, a list of neighbours of each, and where searches begin: the medoid, and an entry to each part that is not reached from there."""

    def __init__(self, x: np.ndarray, lists: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        self.medoid = int(np.argmax(self.x @ self.x.mean(axis=0)))
        self.lists, self.entries = lists, np.array([self.medoid])
        if lists is not None:
            self._enter(np.ones(len(x), bool))
        else:
            self.lists = np.full((len(x), DEGREE), -1, np.int32)
            order = np.r_[self.medoid, np.delete(np.arange(len(x)), self.medoid)]
            at, size = 0, FIRST
            while at < len(order):
                self._insert(order[at : at + size], at > 0)
                at, size = at + size, min(BATCH, 2 * size)
                there = np.zeros(len(x), bool)
                there[order[:at]] = True
                self._enter(there)

    def _enter(self, there: np.ndarray) -> None:
        """Entries from which all nodes that are there are reached."""
        left, entries, new = there.copy(), [], np.array([self.medoid])
        while len(new):
            entries.append(new)
            left[new] = False
            while len(new):
                new = self.lists[new].ravel()
                new = np.unique(new[new >= 0])
                new = new[left[new]]
                left[new] = False
            rest = np.flatnonzero(left)
            to = self.lists[rest]
            inside = (to >= 0) & left[to]
            member = forest(rest[np.nonzero(inside)[0]], to[inside].astype(np.int64))[0]
            new = np.setdiff1d(rest, member)  # one of each part; what it does not reach gets another
        self.entries = np.concatenate(entries)

    def search(self, q: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The BEAM nodes nearest to each query that a greedy walk from the entries, and from its own node, finds, -1 where there are fewer, and their similarities."""
        ids, sims, done = np.full((len(q), BEAM), -1, np.int32), np.full((len(q), BEAM), -np.inf, np.float32), np.ones((len(q), BEAM), bool)
        begin, near = _nearest(np.broadcast_to(self.entries, (len(q), len(self.entries))), q @ self.x[self.entries].T, BEAM - 1)
        n = begin.shape[1]
        ids[:, :n], sims[:, :n], done[:, :n] = begin, near, False
        if own is not None:
            new = ~(ids == own[:, None]).any(axis=1)
            ids[new, n], sims[new, n], done[new, n] = own[new], np.einsum("ij,ij->i", q[new], self.x[own[new]]), False
        act = np.arange(len(q))
        while True:
            act = act[~done[act].all(axis=1)]
            if not len(act):
                return ids, sims
            i, s, d = ids[act], sims[act], done[act]
            todo = np.where(d, -np.inf, s)
            pick = np.argpartition(-todo, WIDE - 1, axis=1)[:, :WIDE]
            near = self.lists[np.take_along_axis(i, pick, 1)]
            near[~np.isfinite(np.take_along_axis(todo, pick, 1))] = -1
            np.put_along_axis(d, pick, True, 1)
            near = np.sort(near.reshape(len(act), -1), axis=1)
            bad = near < 0
            bad[:, 1:] |= near[:, 1:] == near[:, :-1]
            bad |= (near[:, :, None] == i[:, None, :]).any(axis=2)
            sim = (self.x[np.maximum(near, 0)] @ q[act][:, :, None])[:, :, 0]
            sim[bad] = -np.inf
            i, s, d = np.concatenate([i, near], 1), np.concatenate([s, sim], 1), np.concatenate([d, bad], 1)
            top = np.argpartition(-s, BEAM - 1, axis=1)[:, :BEAM]
            ids[act], sims[act], done[act] = np.take_along_axis(i, top, 1), np.take_along_axis(s, top, 1), np.take_along_axis(d, top, 1)

    def _insert(self, new: np.ndarray, grown: bool) -> None:
        q = self.x[new]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        cand, sim = _nearest(np.broadcast_to(new.astype(np.int32), inner.shape), inner, BEAM)
        if grown:
            found = self.search(q)
            cand, sim = _nearest(np.concatenate([cand, found[0]], 1), np.concatenate([sim, found[1]], 1), BEAM)
        self.lists[new] = pruned(self.x, cand, sim)
        self._back(new)

    def _back(self, new: np.ndarray) -> None:
        """The new nodes in the lists of those in theirs."""
        a, b = self.lists[new].ravel(), np.repeat(new, DEGREE)
        a, b = a[a >= 0].astype(np.int64), b[a >= 0]
        had = self.lists[(nodes := np.unique(a))]
        a, b = np.r_[a, np.repeat(nodes, DEGREE)[had.ravel() >= 0]], np.r_[b, had.ravel()[had.ravel() >= 0]]
        both = np.unique(a << 32 | b)
        a, b = both >> 32, (both & 0xFFFFFFFF).astype(np.int32)
        sim = np.einsum("ij,ij->i", self.x[a], self.x[b])
        order = np.lexsort((-sim, a))
        a, b, sim = a[order], b[order], sim[order]
        begin = np.searchsorted(a, nodes)
        size = np.diff(np.r_[begin, len(a)])
        row, rank = np.repeat(np.arange(len(nodes)), size), np.arange(len(a)) - np.repeat(begin, size)
        lists, fits = np.full((len(nodes), DEGREE), -1, np.int32), (size <= DEGREE)[row]
        lists[row[fits], rank[fits]] = b[fits]
        over = np.flatnonzero(size > DEGREE)
        wide = min(2 * DEGREE, int(size.max()))
        for at in range(0, len(over), 4 * BATCH):
            some = over[at : at + 4 * BATCH]
            to = np.full(len(nodes), -1)
            to[some] = np.arange(len(some))
            mine = (to[row] >= 0) & (rank < wide)
            cand, s = np.full((len(some), wide), -1, np.int32), np.full((len(some), wide), -np.inf, np.float32)
            cand[to[row[mine]], rank[mine]], s[to[row[mine]], rank[mine]] = b[mine], sim[mine]
            lists[some] = pruned(self.x, cand, s)
        self.lists[nodes] = lists
