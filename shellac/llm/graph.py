"""A robust-pruned directed graph over unit vectors, built and searched with batched numpy steps."""

from __future__ import annotations

import numpy as np

_FAR = np.float32(np.inf)


class Graph:
    """Out-neighbours of each point (-1 pads) and the entry point, nearest to the mean."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray, entry: int):
        self.x, self.links, self.entry = vectors, neighbours, entry

    def search(self, queries: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of all queries in step: ids (queries, beam), nearest first, -1 pads, and their distances.

        The distance is 1 - dot. In each step the nearest ``expand`` points of a beam that were not yet gone through hand in
        their neighbours, until every point of the beam was.
        """
        n, q = len(self.x), len(queries)
        row = np.arange(q)[:, None]
        ids = np.full((q, beam), -1, np.int32)
        dist = np.full((q, beam), _FAR, np.float32)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True
        ids[:, 0], dist[:, 0], done[:, 0] = self.entry, 1 - queries @ self.x[self.entry], False
        seen[:, self.entry] = True
        active = np.arange(q)
        while len(active):
            a_row = row[: len(active)]
            a_ids, a_dist, a_done = ids[active], dist[active], done[active]
            order = np.argsort(np.where(a_done, _FAR, a_dist), axis=1, kind="stable")[:, :expand]
            chosen = np.where(a_done[a_row, order], -1, a_ids[a_row, order])
            a_done[a_row, order] = True
            new = np.where(chosen[:, :, None] >= 0, self.links[chosen], -1).reshape(len(active), -1)
            new = np.where(new < 0, n, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new[seen[active[:, None], new]] = n
            seen[active[:, None], new] = True
            width = int((new < n).sum(1).max())
            new.sort(axis=1)
            new = new[:, : max(1, width)]
            near = self.x[np.minimum(new, n - 1)]
            d = np.where(new < n, 1 - np.einsum("qnd,qd->qn", near, queries[active]), _FAR).astype(np.float32)
            all_ids, all_dist = np.concatenate([a_ids, new.astype(np.int32)], 1), np.concatenate([a_dist, d], 1)
            all_done = np.concatenate([a_done, np.zeros(new.shape, bool)], 1)
            all_done[all_dist == _FAR] = True
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[active], dist[active], done[active] = all_ids[a_row, order], all_dist[a_row, order], all_done[a_row, order]
            active = active[~done[active].all(1)]
        ids[dist == _FAR] = -1
        return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each point out of its candidates (rows, -1 pads): the nearest is kept and takes out every one that is
    ``alpha`` times nearer to it than to the point, until ``degree`` are kept, so that the kept edges point in diverse
    directions."""
    c = candidates.copy()
    c[c == points[:, None]] = -1
    c.sort(axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    v = x[np.maximum(c, 0)]
    to_point = np.where(c >= 0, 1 - np.einsum("pcd,pd->pc", v, x[points]), _FAR).astype(np.float32)
    between = 1 - v @ v.transpose(0, 2, 1)
    out = np.full((len(points), degree), -1, np.int32)
    row, left = np.arange(len(points)), to_point.copy()
    for k in range(degree):
        best = left.argmin(1)
        there = left[row, best] < _FAR
        if not there.any():
            break
        out[there, k] = c[row, best][there]
        left[alpha * between[row, best] <= to_point] = _FAR
        left[row, best] = _FAR
    return out


def build(vectors: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 11) -> Graph:
    """Build the graph over unit vectors, in batches that grow with it.

    The points of a batch search the graph so far, prune what their search went through, and are linked back by their
    neighbours, which are pruned again when they get more than ``degree``. A second round relinks all points.
    """
    n = len(vectors)
    x = np.ascontiguousarray(vectors, np.float32)
    rng = np.random.default_rng(seed)
    links = np.full((n + 1, degree), -1, np.int32)
    entry = int((x @ x.mean(0)).argmax()) if n else 0
    graph = Graph(x, links, entry)
    order = rng.permutation(n)
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int64) if n else order
    for again in (False, True):
        at = 0 if again else 1
        while at < n:
            points = order[at : at + (batch if again else min(batch, max(1, at)))]
            at += len(points)
            found, _ = graph.search(x[points], beam)
            if not again and at <= batch:  # the first points also see one another
                found = np.concatenate([found, np.broadcast_to(points, (len(points), len(points)))], 1)
            found = np.concatenate([found, links[points]], 1)
            links[points] = robust_prune(x, points, found.astype(np.int32), degree, alpha)
            _link_back(graph, points, degree, alpha)
    return graph


def _link_back(graph: Graph, points: np.ndarray, degree: int, alpha: float) -> None:
    links = graph.links
    source = np.repeat(points, degree)
    target = links[points].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
    if not len(heads):
        return
    for some in np.array_split(np.arange(len(heads)), max(1, len(heads) // 512)):
        width = int(counts[some].max())
        own = np.full((len(some), width), -1, np.int32)
        place = np.arange(width)[None, :] < counts[some][:, None]
        own[place] = np.concatenate([source[s : s + c] for s, c in zip(starts[some], counts[some])])
        old = links[heads[some]]
        both = np.concatenate([old, own], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both[both == heads[some][:, None]] = -1
        fits = (both >= 0).sum(1) <= degree
        if fits.any():
            packed = -np.sort(-both[fits], axis=1)[:, :degree]
            links[heads[some][fits], : packed.shape[1]] = packed
            links[heads[some][fits], packed.shape[1] :] = -1
        if (~fits).any():
            links[heads[some][~fits]] = robust_prune(graph.x, heads[some][~fits], both[~fits], degree, alpha)
