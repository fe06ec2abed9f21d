"""A tree over a small set of integer vectors that finds the nearest one exactly (geometric near-neighbour access tree).

A node holds split points, each with the entries nearest to it as a child, and for every pair of a split point and
a child the range of distances between them. A query's distance to a split point rules a child out when even its
best so far cannot reach into that range; the test is strict and allows for rounding, so entries at equal distance
stay in. What is left is compared by integer squared distances, ties to the lower index. Many queries go down
together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Split points of a node; a node of up to twice as many entries is not split further.
DEGREE = 12
#: Relative and absolute allowance for the rounding of square roots.
_LOOSE = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of all rows of ``a`` to all rows of ``b``."""
    reach = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if reach * reach * max(a.shape[1], 1) * 4 < 1 << 53:  # doubles hold every partial sum
        x, y = a.astype(np.float64), b.astype(np.float64)
        return np.rint(np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ y.T) + np.einsum("ij,ij->i", y, y)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.empty((len(a), 0), np.int64)


@dataclass
class Node:
    entries: np.ndarray  # indexes of a leaf's entries, or of the split points
    children: list["Node | None"] = field(default_factory=list)
    low: np.ndarray | None = None  # [split point, child] distance ranges
    high: np.ndarray | None = None


def build(points: np.ndarray, entries: np.ndarray | None = None, degree: int = DEGREE) -> Node:
    """The tree over ``points`` (or those numbered ``entries``)."""
    entries = np.arange(len(points)) if entries is None else entries
    if len(entries) <= 2 * degree:
        return Node(entries)
    own = points[entries]
    chosen, far = [0], squared(own, own[:1])[:, 0]
    while len(chosen) < degree and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(own, own[chosen[-1]:chosen[-1] + 1])[:, 0])
    if len(chosen) == 1:  # all entries are equal
        return Node(entries)
    d = squared(own, own[chosen])
    home = d.argmin(axis=1)
    root = np.sqrt(d.astype(np.float64))
    rest = np.ones(len(entries), bool)
    rest[chosen] = False
    node = Node(entries[chosen], low=np.full((len(chosen), len(chosen)), np.inf), high=np.full((len(chosen), len(chosen)), -np.inf))
    for c in range(len(chosen)):
        inside = np.flatnonzero(rest & (home == c))
        node.children.append(build(points, entries[inside], degree) if len(inside) else None)
        if len(inside):
            node.low[:, c], node.high[:, c] = root[inside].min(axis=0), root[inside].max(axis=0)
    return node


def nearest(node: Node, points: np.ndarray, queries: np.ndarray, visits: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each query; ``visits`` takes the number of distances of every step."""
    index = np.full(len(queries), np.iinfo(np.int64).max)
    best = np.full(len(queries), np.iinfo(np.int64).max)
    _descend(node, points, queries, np.arange(len(queries)), index, best, visits)
    return index, best


def _descend(node: Node, points: np.ndarray, queries: np.ndarray, at: np.ndarray, index: np.ndarray, best: np.ndarray, visits: list | None) -> None:
    d = squared(queries[at], points[node.entries])
    if visits is not None:
        visits.append(d.size)
    least = d.min(axis=1)
    first = np.where(d == least[:, None], node.entries, np.iinfo(np.int64).max).min(axis=1)
    better = (least < best[at]) | ((least == best[at]) & (first < index[at]))
    best[at[better]], index[at[better]] = least[better], first[better]
    if not node.children:
        return
    root = np.sqrt(d.astype(np.float64))
    home = d.argmin(axis=1)
    _visit(node, points, queries, at, home[:, None] == np.arange(d.shape[1]), index, best, visits)
    # what is left open once the nearest child has been seen; every split point may rule out every child
    reach = np.sqrt(best[at].astype(np.float64))
    least, most = root - reach[:, None], root + reach[:, None]
    slack = (_LOOSE * (1 + most)).max(axis=1, keepdims=True)
    least, most = least - slack, most + slack
    open_ = home[:, None] != np.arange(d.shape[1])
    for i in range(d.shape[1]):
        open_ &= (least[:, i, None] <= node.high[i]) & (most[:, i, None] >= node.low[i])
    _visit(node, points, queries, at, open_, index, best, visits)


def _visit(node: Node, points: np.ndarray, queries: np.ndarray, at: np.ndarray, wanted: np.ndarray, index: np.ndarray, best: np.ndarray, visits: list | None) -> None:
    for c, child in enumerate(node.children):
        own = at[wanted[:, c]]
        if child is not None and len(own):
            _descend(child, points, queries, own, index, best, visits)
