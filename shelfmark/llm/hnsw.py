"""A hierarchical navigable small-world graph with numpy, built and queried in batches.

All queries of a batch move together: each round takes every node that entered some query's beam,
looks at its neighbours, and keeps the best ``ef`` of each query. Nodes at or above a similarity
``floor`` are always expanded, so a query with more near vectors than its beam still meets them all.
"""

from __future__ import annotations

import numpy as np

LINKS, BATCH, PAIRS = 12, 256, 1 << 15


class Graph:
    """Graph over unit vectors (float32 rows); nodes are inserted in batches, those of high levels first."""

    def __init__(self, vectors: np.ndarray, ef: int = 32, seed: int = 5):
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(int), 6)
        self.order = np.argsort(-levels, kind="stable")
        self.x = vectors[self.order]
        levels = levels[self.order]
        self.counts = [int((levels >= k).sum()) for k in range(int(levels[0]) + 1 if n else 1)]  # nodes of level k are 0 .. counts[k] - 1
        self.near = [np.full((c, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, c in enumerate(self.counts)]
        at = 0
        while at < n:
            to = min(n, at + min(BATCH, max(8, at)))
            self._insert(np.arange(at, to), levels, ef)
            at = to
        self._ring()

    def _ring(self) -> None:
        """Two more links a node, to its places in a ring of all, so that pruning leaves no node out of reach.

        The ring goes from one level-1 node's surroundings to the next, by similarity within each.
        """
        n = len(self.x)
        if n < 2:
            return
        home, sims = np.zeros(n, np.int64), np.zeros(n, np.float32)
        for k in range(0, n, BATCH):
            q = self.x[k : k + BATCH]
            if len(self.counts) > 1:
                ids, s, _ = self.beam(q, self._entries(q, 1), 1, min(8, self.counts[1]))
                best = s.argmax(1)
                home[k : k + BATCH], sims[k : k + BATCH] = ids[np.arange(len(q)), best], s[np.arange(len(q)), best]
        ring = np.lexsort((-sims, home))
        ends = np.empty((n, 2), np.int32)
        ends[ring, 0], ends[ring, 1] = np.roll(ring, -1), np.roll(ring, 1)
        self.near[0] = np.concatenate([self.near[0], ends], 1)

    def _sims(self, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.float32)
        for k in range(0, len(a), PAIRS):
            out[k : k + PAIRS] = np.einsum("ij,ij->i", q[a[k : k + PAIRS]], self.x[b[k : k + PAIRS]])
        return out

    def beam(self, q: np.ndarray, entry: np.ndarray, level: int, ef: int, floor: float = 2.0) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(ids, similarities) of each query's best ``ef`` at a level, and all pairs (query, node) met at or above ``floor``."""
        near, n = self.near[level], self.counts[level]
        stamp = np.full((len(q), n), -1, np.int32)
        rows, nodes = np.repeat(np.arange(len(q)), entry.shape[1]), entry.ravel().astype(np.int64)
        rows, nodes = rows[nodes >= 0], nodes[nodes >= 0]
        ids, sims = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -2, np.float32)
        met: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            order = np.arange(len(rows), dtype=np.int32)  # a node new to a query, once a round
            fresh = stamp[rows, nodes] == -1
            rows, nodes, order = rows[fresh], nodes[fresh], order[fresh]
            stamp[rows, nodes] = order
            once = stamp[rows, nodes] == order
            rows, nodes = rows[once], nodes[once]
            if not len(rows):
                break
            s = self._sims(q, rows, nodes)
            good = s >= floor
            if good.any():
                met.append((rows[good], nodes[good]))
            starts = np.searchsorted(rows, np.arange(len(q) + 1))
            place = np.arange(len(rows)) - starts[rows]
            wide = int(np.diff(starts).max())
            more_ids, more = np.full((len(q), wide), -1, np.int64), np.full((len(q), wide), -2, np.float32)
            more_ids[rows, place], more[rows, place] = nodes, s
            all_ids, all_sims = np.concatenate([ids, more_ids], 1), np.concatenate([sims, more], 1)
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids, sims = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            grow = good | (s >= sims.min(1)[rows])
            rows, nodes = rows[grow], nodes[grow]
            next_ = near[nodes]
            rows, nodes = np.repeat(rows, next_.shape[1]), next_.ravel().astype(np.int64)
            rows, nodes = rows[nodes >= 0], nodes[nodes >= 0]
        return ids, sims, (np.concatenate([a for a, _ in met]), np.concatenate([b for _, b in met])) if met else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _entries(self, q: np.ndarray, down_to: int) -> np.ndarray:
        entry = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.counts) - 1, down_to, -1):
            entry = self.beam(q, entry, level, 4)[0]
        return entry

    def _pick(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to one another, then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * LINKS + 16]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        x = self.x[ids]
        between = x @ x.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            far = ~((between[:, k, :] > sims[:, k, None]) & taken).any(1)
            taken[:, k] = (ids[:, k] >= 0) & far & (taken.sum(1) < most * 2 // 3)
        rank = np.where(taken, 0, 1) + np.where(ids >= 0, 0, 2)
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, first, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _insert(self, new: np.ndarray, levels: np.ndarray, ef: int) -> None:
        q, before = self.x[new], int(new[0])
        own = q @ q.T
        np.fill_diagonal(own, -2)
        for level in range(len(self.counts) - 1, -1, -1):
            some = np.flatnonzero(levels[new] >= level)
            if not len(some):
                continue
            most = self.near[level].shape[1]
            k = min(len(some) - 1, 8)
            mine = own[np.ix_(some, some)]
            best = np.argpartition(-mine, k - 1, axis=1)[:, :k] if k else np.zeros((len(some), 0), np.int64)  # the batch's own nearest
            ids, sims = new[some][best], np.take_along_axis(mine, best, 1)
            if before:
                entry = self._entries(q[some], level)
                old, s, _ = self.beam(q[some], entry, level, min(ef, max(1, min(before, self.counts[level]))))
                ids, sims = np.concatenate([old, ids], 1), np.concatenate([s, sims], 1)
            if not ids.shape[1]:
                continue
            self.near[level][new[some]] = self._pick(new[some], ids, sims, most)
            self._link_back(level, new[some])

    def _link_back(self, level: int, new: np.ndarray) -> None:
        near = self.near[level]
        most = near.shape[1]
        a, b = np.repeat(new, most), near[new].ravel().astype(np.int64)
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, first = np.unique(b, return_index=True)
        counts = np.diff([*first, len(b)])
        wide = int(counts.max()) if len(nodes) else 0
        if not wide:
            return
        extra = np.full((len(nodes), wide), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), counts), np.arange(len(b)) - np.repeat(first, counts)] = a
        ids = np.concatenate([near[nodes].astype(np.int64), extra], 1)
        ids.sort(1)  # a repeated neighbour counts once
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        full = (ids >= 0).sum(1) > most
        packed = -np.sort(-ids[~full], axis=1)[:, :most]
        near[nodes[~full]] = np.pad(packed, ((0, 0), (0, max(0, most - packed.shape[1]))), constant_values=-1)
        for k in range(0, int(full.sum()), 64):
            some = np.flatnonzero(full)[k : k + 64]
            sims = np.where(ids[some] >= 0, np.einsum("bd,bid->bi", self.x[nodes[some]], self.x[ids[some]]), -2)
            near[nodes[some]] = self._pick(nodes[some], ids[some], sims, most)

    def within(self, q: np.ndarray, floor: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row of ``vectors``) pairs met at or above ``floor``."""
        rows, nodes = [], []
        for k in range(0, len(q), BATCH):
            part = q[k : k + BATCH]
            a, b = self.beam(part, self._entries(part, 0), 0, min(ef, len(self.x)), floor)[2]
            rows.append(a + k)
            nodes.append(self.order[b])
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _exact(vectors: np.ndarray, q: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row of ``vectors``) pairs clearly at or above ``floor``, by brute force."""
    found = [(k + b, a) for k in range(0, len(vectors), 4096) for b, a in [np.nonzero(vectors[k : k + 4096] @ q.T >= floor + 2e-6)]]
    return (np.concatenate([a for _, a in found]), np.concatenate([b for b, _ in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _audit(vectors: np.ndarray, q: np.ndarray, floor: float, sample: int, members: np.ndarray, scan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, place in them, row of ``vectors``): queries that have neighbours, with all of these.

    Half of ``sample`` are members, who have themselves; the rest are other queries with a neighbour, looked
    for in ``scan`` queries, or in all of them if nothing has been found by then.
    """
    draw = np.random.default_rng(5).permutation
    own = draw(np.flatnonzero(members))[: (sample + 1) // 2]
    others = draw(np.flatnonzero(~members))
    some, rows, nodes, n = [], [], [], 0

    def take(part: np.ndarray) -> int:
        a, b = _exact(vectors, q[part], floor)
        having, place = np.unique(a, return_inverse=True)
        keep = place < sample - n
        some.append(part[having[: sample - n]])
        rows.append(place[keep] + n)
        nodes.append(b[keep])
        return len(some[-1])

    if len(own):
        n += take(own)
    for k in range(0, len(others), 512):
        if n >= sample or (n and k >= scan):
            break
        n += take(others[k : k + 512])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(some), join(rows), join(nodes)


def audited(graph: Graph, vectors: np.ndarray, q: np.ndarray, floor: float, ef: int, sample: int, recall: float, members: np.ndarray | None = None, scan: int = 4096) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs at or above ``floor``; the beam doubles until recall against brute force passes.

    Recall is the mean over up to ``sample`` queries that have neighbours, so a query with very many
    doesn't outweigh others. ``members`` marks queries that are among ``vectors``. If there is no such
    query, brute force has seen all queries and there are no pairs.
    """
    some, rows, nodes = _audit(vectors, q, floor, sample, np.zeros(len(q), bool) if members is None else members, scan)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), ef
    exact = np.bincount(rows, minlength=len(some))
    while ef < len(vectors):
        a, b = graph.within(q[some], floor, ef)
        met = np.isin(rows * len(vectors) + nodes, a * len(vectors) + b)
        if (np.bincount(rows[met], minlength=len(some)) / exact).mean() >= recall:
            break
        ef *= 2
    return *graph.within(q, floor, ef), ef
