"""Cover trees over blocks of vectors, and the search of one by another for the largest inner products."""

from __future__ import annotations

import heapq

import numpy as np

#: Most points of a leaf, and most children of a node; a node has no more than two for each leaf that its points fill, as many small leaves
#: take longer to pair than to score.
LEAF, FAN_OUT = 128, 48


class CoverTree:
    """Nodes with a point as centre and the exact radius that covers all below them.

    A node's points are covered by children of half its radius, taken farthest
    first; past the most children the rest go to the nearest, whose radii grow
    accordingly. A node of LEAF points or fewer, or of equal points, is a leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.norm: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray | None] = []
        self.span: list[tuple[int, int]] = []  # of leaves, as numbered in order
        self.leaves = 0
        if len(points):
            self._build(np.arange(len(points)), points[0], leaf)

    def _build(self, at: np.ndarray, centre: np.ndarray, leaf: int) -> int:
        me = len(self.centre)
        away = np.sqrt(((self.points[at] - centre) ** 2).sum(axis=1))
        radius = float(away.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.norm.append(float(np.sqrt((centre**2).sum())))
        self.children.append([])
        self.members.append(None)
        self.span.append((self.leaves, self.leaves))
        first = self.leaves
        if len(at) <= leaf or radius == 0:
            self.members[me] = at
            self.leaves += 1
        else:
            nearest, owner, chosen = away, np.zeros(len(at), np.int64), [centre]
            most = min(FAN_OUT, 2 * -(-len(at) // leaf))
            while nearest.max() > radius / 2 and len(chosen) < most:
                new = self.points[at[int(nearest.argmax())]]
                d = np.sqrt(((self.points[at] - new) ** 2).sum(axis=1))
                closer = d < nearest
                owner[closer] = len(chosen)
                nearest = np.minimum(nearest, d)
                chosen.append(new)
            self.children[me] = [self._build(own, chosen[k], leaf) for k in range(len(chosen)) if len(own := at[owner == k])]
        self.span[me] = (first, self.leaves)
        return me


class _Best:
    """The k best candidates of each query, the best first; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.zeros((queries, k), np.int64)
        self.worst = np.full(queries, -np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes scores of all ``rows`` and ``ids``; what is -inf is no candidate."""
        better = (scores >= self.worst[rows][:, None]) & (scores > -np.inf)
        counts = better.sum(axis=1)
        some = counts > 0
        if not some.any():
            return
        rows, new, width = rows[some], np.where(better[some], scores[some], -np.inf), int(counts.max())
        at = np.argpartition(-new, width - 1, axis=1)[:, :width] if width < new.shape[1] else np.broadcast_to(np.arange(width), new.shape)
        s = np.concatenate([self.scores[rows], np.take_along_axis(new, at, axis=1)], axis=1)
        n = np.concatenate([self.ids[rows], ids[at]], axis=1)
        order = np.lexsort((n, -s), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(n, order, axis=1)
        self.worst[rows] = self.scores[rows, -1]


def dual_tree_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, data_id, score) of the k largest inner products of each query, over rows with another id.

    Pairs of nodes are taken by their upper bound |q||p| sums of centres and
    radii, the largest first, and dropped where it is under the worst kth score
    of the query node's queries; that keeps every candidate that ties.
    """
    best = _Best(len(queries), k)
    if not len(queries) or not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, d = CoverTree(queries, leaf), CoverTree(data, leaf)
    worst = np.full(q.leaves, -np.inf)
    d_centre, d_norm, d_radius = np.array(d.centre), np.array(d.norm), np.array(d.radius)

    def bounds(a: int, nodes: list[int]) -> np.ndarray:
        b = d_centre[nodes] @ q.centre[a] + q.norm[a] * d_radius[nodes] + d_norm[nodes] * q.radius[a] + q.radius[a] * d_radius[nodes]
        return b + 1e-9 * np.abs(b) + 1e-9

    heap = [(-float(bounds(0, [0])[0]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        first, end = q.span[a]
        if -bound < worst[first:end].min():
            continue
        if q.members[a] is not None and d.members[b] is not None:
            rows, cols = q.members[a], d.members[b]
            scores = queries[rows] @ data[cols].T
            scores = np.where(query_ids[rows][:, None] == data_ids[cols][None, :], -np.inf, scores)
            scores[~np.isfinite(scores)] = -np.inf
            best.offer(rows, data_ids[cols], scores)
            worst[first] = best.worst[rows].min()
        elif d.members[b] is None and (q.members[a] is not None or d.radius[b] >= q.radius[a]):
            for c, x in zip(d.children[b], bounds(a, d.children[b]).tolist()):
                heapq.heappush(heap, (-x, a, c))
        else:
            for c in q.children[a]:
                heapq.heappush(heap, (-float(bounds(c, [b])[0]), c, b))
    found = best.scores > -np.inf
    return np.repeat(query_ids, found.sum(axis=1)), best.ids[found], best.scores[found]
