"""Even-odd polygons as edge arrays: cutting by lines, union and shared area by trapezoids.

An edge is a row (x0, y0, x1, y1) with y0 < y1; horizontal edges bound no trapezoid and are left out. Between two neighbouring
heights at which an edge ends or two edges cross, the order of the edges never changes, so all figures there are those
of the middle line, times the height. Results are exact but for the rounding of doubles.
"""

from __future__ import annotations

import numpy as np

#: Cells of the (slab, edge) table that are held at once.
TABLE = 1 << 20


def ring_edges(ring: np.ndarray) -> np.ndarray:
    """Edges of a closed ring of points, without repeated last point."""
    e = np.hstack([ring, np.roll(ring, -1, axis=0)])
    e = e[e[:, 1] != e[:, 3]]
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return e


def cut_ring(ring: np.ndarray, axis: int, at: float, above: bool) -> np.ndarray:
    """The part of a ring on one side of a line; where it falls apart, parts stay joined along the line, which bounds no area."""
    v = ring[:, axis]
    inside = v >= at if above else v <= at
    if inside.all():
        return ring
    nxt, inside_next = np.roll(ring, -1, axis=0), np.roll(inside, -1)
    crosses = inside != inside_next
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (at - v) / (nxt[:, axis] - v)
        point = ring + np.where(crosses, t, 0)[:, None] * (nxt - ring)
    point[:, axis] = at
    return np.stack([ring, point], axis=1)[np.stack([inside, crosses], axis=1)]


def cut_to_cells(ring: np.ndarray, cell: float):
    """(cx, cy, part of the ring) for every cell that a ring reaches, by halving; a part never leaves its cell."""
    c0, c1 = np.floor(ring.min(axis=0) / cell).astype(int), np.ceil(ring.max(axis=0) / cell).astype(int)
    todo = [(ring, c0, np.maximum(c1, c0 + 1))]
    while todo:
        part, low, high = todo.pop()
        if len(part) < 3:
            continue
        axis = int(np.argmax(high - low))
        if high[axis] - low[axis] == 1:
            yield int(low[0]), int(low[1]), part
            continue
        middle = (low[axis] + high[axis]) // 2
        step = np.eye(2, dtype=int)[axis]
        todo.append((cut_ring(part, axis, middle * cell, False), low, high + step * (middle - high[axis])))
        todo.append((cut_ring(part, axis, middle * cell, True), low + step * (middle - low[axis]), high))


def crossing_heights(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross inside both."""
    out, step = [], max(1, TABLE // max(len(e), 1))
    low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    for a in range(0, len(e), step):
        s = slice(a, a + step)
        meet = (e[s, 1, None] < e[:, 3]) & (e[:, 1] < e[s, 3, None]) & (low[s, None] <= high) & (low <= high[s, None])
        i, j = np.nonzero(meet & (np.arange(len(e)) > np.arange(a, a + len(low[s]))[:, None]))
        i += a
        d, f, g = e[i, 2:] - e[i, :2], e[j, 2:] - e[j, :2], e[j, :2] - e[i, :2]
        turn = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0]
        ok = turn != 0
        d, f, g, turn, i = d[ok], f[ok], g[ok], turn[ok], i[ok]
        t, u = (g[:, 0] * f[:, 1] - g[:, 1] * f[:, 0]) / turn, (g[:, 0] * d[:, 1] - g[:, 1] * d[:, 0]) / turn
        inside = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append((e[i, 1] + t * d[:, 1])[inside])
    return np.concatenate(out) if out else np.empty(0)


def _at(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    return e[..., 0] + (e[..., 2] - e[..., 0]) * ((y - e[..., 1]) / (e[..., 3] - e[..., 1]))


def _lines(e: np.ndarray, shape: np.ndarray):
    """(heights, first slab, order of the edges, their x, +1 or -1 as a shape is entered or left) of blocks of slabs."""
    ys = np.unique(np.concatenate([e[:, 1], e[:, 3], crossing_heights(e)]))
    # heights that rounding alone tells apart are one: between them no line would lie clear of corners
    ys = ys[np.concatenate([[True], np.diff(ys) > 64 * np.spacing(np.abs(ys).max())])]
    step = max(1, TABLE // max(len(e), 1))
    for a in range(0, len(ys) - 1, step):
        middle = (ys[a:a + step + 1][1:] + ys[a:a + step + 1][:-1])[:, None] / 2
        x = np.where((e[:, 1] < middle) & (middle < e[:, 3]), _at(e[None], middle), np.inf)
        order = np.argsort(x, axis=1, kind="stable")
        most = max(1, int(np.isfinite(x).sum(axis=1).max()))
        order = order[:, :most]
        x = np.take_along_axis(x, order, axis=1)
        own = np.where(np.isfinite(x), shape[order], -1)
        yield ys, a, order, x, _signs(own)


def union_edges(e: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Edges of disjoint trapezoids that cover what lies in at least one shape; two following rows are a trapezoid's sides."""
    parts = []
    ys = np.empty(0)
    for ys, a, order, x, sign in _lines(e, shape) if len(e) else ():
        n = np.cumsum(sign, axis=1)
        opens, closes = (n == 1) & (sign == 1), (n == 0) & (sign == -1)
        clear = opens.sum(axis=1) == closes.sum(axis=1)  # a line through a corner; its slab is as thin as the rounding
        opens, closes = opens & clear[:, None], closes & clear[:, None]
        slab = np.nonzero(opens)[0] + a
        wide = x[closes] > x[opens]
        parts.append(np.stack([slab, order[opens], order[closes]], axis=1)[wide])
    if not parts or not sum(map(len, parts)):
        return np.empty((0, 4))
    s, left, right = np.concatenate(parts).T
    at = np.lexsort((s, right, left))
    s, left, right = s[at], left[at], right[at]
    new = np.concatenate([[True], (np.diff(left) != 0) | (np.diff(right) != 0) | (np.diff(s) != 1)])
    low, high = ys[s[new]], ys[s[np.concatenate([new[1:], [True]])] + 1]
    sides = [np.stack([_at(e[k], low), low, _at(e[k], high), high], axis=1) for k in (left[new], right[new])]
    return np.stack(sides, axis=1).reshape(-1, 4)


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that lies in both of two even-odd edge sets."""
    if not len(a) or not len(b):
        return 0.0
    low, high = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 3].max(), b[:, 3].max())
    right = min(a[:, ::2].max(), b[:, ::2].max())  # what lies right of either bounds nothing shared
    a, b = (e[(e[:, 3] > low) & (e[:, 1] < high) & (np.minimum(e[:, 0], e[:, 2]) <= right)] for e in (a, b))
    if not len(a) or not len(b):
        return 0.0
    e, shape = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    total = 0.0
    for ys, k, order, x, sign in _lines(e, shape):
        inside = (np.cumsum(sign, axis=1) == 2)[:, :-1]
        width = np.where(inside, np.diff(np.where(np.isfinite(x), x, 0), axis=1), 0).sum(axis=1)
        total += float((width * np.diff(ys[k:k + len(x) + 1])).sum())
    return total


def area(e: np.ndarray) -> float:
    """Area of an even-odd edge set."""
    total = 0.0
    for ys, k, order, x, sign in _lines(e, np.zeros(len(e), int)) if len(e) else ():
        inside = (np.cumsum(sign, axis=1) == 1)[:, :-1]
        width = np.where(inside, np.diff(np.where(np.isfinite(x), x, 0), axis=1), 0).sum(axis=1)
        total += float((width * np.diff(ys[k:k + len(x) + 1])).sum())
    return total


# ── many small polygons at once ──────────────────────────────────────────────

#: Edges of a pair up to which it is measured together with others, and pairs whose edges are brought together at once.
SHORT, PAIRS = 48, 1 << 13


def _next(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first point of every ring, following point of every point) of rings that lie behind one another."""
    first = np.cumsum(size) - size
    following = np.arange(1, size.sum() + 1)
    following[first + size - 1] = first
    return first, following


def _cut_rings(xy: np.ndarray, size: np.ndarray, axis: np.ndarray, at: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """``cut_ring`` of many rings, each along its own line."""
    first, following = _next(size)
    row, axis, at = np.arange(len(xy)), np.repeat(axis, size), np.repeat(at, size)
    v = xy[row, axis]
    inside = v >= at if above else v <= at
    crosses = inside != inside[following]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (at - v) / (v[following] - v)
        point = xy + np.where(crosses, t, 0)[:, None] * (xy[following] - xy)
    point[row, axis] = at
    held = np.stack([inside, crosses], axis=1)
    return np.stack([xy, point], axis=1)[held], np.add.reduceat(held.sum(axis=1), first)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of runs that begin at ``start``, one behind the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def cut_all_to_cells(xy: np.ndarray, size: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring, (cx, cy), points, their number) of every part that ``cut_to_cells`` makes of rings of three points or more."""
    if not len(size):
        return np.empty(0, int), np.empty((0, 2), int), np.empty((0, 2)), np.empty(0, int)
    first = np.cumsum(size) - size
    low = np.floor(np.minimum.reduceat(xy, first) / cell).astype(int)
    high = np.maximum(np.ceil(np.maximum.reduceat(xy, first) / cell).astype(int), low + 1)
    ring, done = np.arange(len(size)), []
    while len(size):
        start, span = np.cumsum(size) - size, high - low
        whole = (span == 1).all(axis=1)
        done.append((ring[whole], low[whole], xy[runs(start[whole], size[whole])], size[whole]))
        todo = ~whole
        if not todo.any():
            break
        xy, size, ring, low, high = xy[runs(start[todo], size[todo])], size[todo], ring[todo], low[todo], high[todo]
        k, axis = np.arange(len(size)), np.argmax(span[todo], axis=1)
        middle = (low[k, axis] + high[k, axis]) // 2
        below, over = high.copy(), low.copy()
        below[k, axis] = over[k, axis] = middle
        parts = [(*_cut_rings(xy, size, axis, middle * cell, side), lo, hi) for side, lo, hi in ((False, low, below), (True, over, high))]
        xy, size = np.concatenate([q[0] for q in parts]), np.concatenate([q[1] for q in parts])
        ring, low, high = np.concatenate([ring, ring]), np.concatenate([q[2] for q in parts]), np.concatenate([q[3] for q in parts])
        kept = size > 2
        xy = xy[np.repeat(kept, size)]
        ring, low, high, size = ring[kept], low[kept], high[kept], size[kept]
    return tuple(np.concatenate(q) for q in zip(*done))


def all_edges(xy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, their ring) of ``ring_edges`` of many rings."""
    e = np.hstack([xy, xy[_next(size)[1]]]) if len(xy) else np.empty((0, 4))
    ring = np.repeat(np.arange(len(size)), size)
    sloped = e[:, 1] != e[:, 3]
    e, ring = e[sloped], ring[sloped]
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return e, ring


def _padded(e: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """(rows, width, ...) of runs of ``e``, filled up with missing values."""
    out = np.full((len(size), width, *e.shape[1:]), np.nan)
    out[np.repeat(np.arange(len(size)), size), runs(np.zeros(len(size), int), size)] = e[runs(start, size)]
    return out


def _signs(own: np.ndarray) -> np.ndarray:
    """+1 or -1 as an edge enters or leaves its shape along a line; 0 for what is filled up (-1)."""
    by = np.argsort(own, axis=1, kind="stable")
    grouped = np.take_along_axis(own, by, axis=1)
    place = np.broadcast_to(np.arange(own.shape[1]), grouped.shape)
    first = np.maximum.accumulate(np.where(np.diff(grouped, axis=1, prepend=-2) != 0, place, 0), axis=1)
    sign = np.empty(own.shape, np.int64)
    np.put_along_axis(sign, by, 1 - 2 * ((place - first) % 2), axis=1)
    return np.where(own >= 0, sign, 0)


def _covered(own: np.ndarray) -> np.ndarray:
    """Whether what follows an edge lies in shape 0 and in at least one other."""
    sign = _signs(own)
    return (np.cumsum(np.where(own == 0, sign, 0), axis=1) == 1) & (np.cumsum(np.where(own > 0, sign, 0), axis=1) > 0)


def _areas_of(e: np.ndarray, shape: np.ndarray, shapes: int | None) -> np.ndarray:
    """Area that lies in all of the ``shapes`` shapes (1 or 2) of every row of (rows, edges, 4); without their number, in shape 0 and any other."""
    x0, y0, x1, y1 = np.moveaxis(e, 2, 0)
    i, j = np.triu_indices(e.shape[1], 1)
    left, right = np.minimum(x0, x1), np.maximum(x0, x1)
    row, k = np.nonzero((y0[:, i] < y1[:, j]) & (y0[:, j] < y1[:, i]) & (left[:, i] <= right[:, j]) & (left[:, j] <= right[:, i]))
    i, j = i[k], j[k]
    d, f, g = e[row, i, 2:] - e[row, i, :2], e[row, j, 2:] - e[row, j, :2], e[row, j, :2] - e[row, i, :2]
    turn = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (g[:, 0] * f[:, 1] - g[:, 1] * f[:, 0]) / turn, (g[:, 0] * d[:, 1] - g[:, 1] * d[:, 0]) / turn
    inside = (turn != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    found, row = (e[row, i, 1] + t * d[:, 1])[inside], row[inside]
    n = np.bincount(row, minlength=len(e))
    ys = np.sort(np.concatenate([y0, y1, _padded(found, np.cumsum(n) - n, n, n.max())], axis=1), axis=1)
    near = np.diff(ys, axis=1) <= 64 * np.spacing(np.nanmax(np.abs(ys), axis=1))[:, None]
    ys[:, 1:][near] = np.nan
    ys = np.sort(ys, axis=1)
    height, middle = np.diff(ys, axis=1), (ys[:, 1:] + ys[:, :-1]) / 2
    row, k = np.nonzero(np.isfinite(height))
    height, middle, e = height[row, k], middle[row, k][:, None], e[row]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where((e[..., 1] < middle) & (middle < e[..., 3]), _at(e, middle), np.inf)
    order = np.argsort(x, axis=1, kind="stable")[:, :max(1, int(np.isfinite(x).sum(axis=1).max(initial=1)))]
    x = np.take_along_axis(x, order, axis=1)
    own = np.where(np.isfinite(x), np.take_along_axis(shape[row], order, axis=1), -1)
    within = _covered(own) if shapes is None else np.logical_and.reduce([np.cumsum(own == s, axis=1) % 2 == 1 for s in range(shapes)])
    within = within[:, :-1]
    x = np.where(np.isfinite(x), x, 0)
    return np.bincount(row, np.where(within, np.diff(x, axis=1), 0).sum(axis=1) * height, minlength=len(shape))


def _measured(e: np.ndarray, shape: np.ndarray, size: np.ndarray, shapes: int | None) -> np.ndarray:
    """``_areas_of`` runs of edges, those of about the same length together."""
    out, start = np.zeros(len(size)), np.cumsum(size) - size
    width = (size + 1) // 2 * 2
    for w in np.unique(width[size > 0]):
        rows = np.nonzero(width == w)[0]
        step = max(1, (TABLE >> 2) // int(w * (2 * w + 8)))
        for k in range(0, len(rows), step):
            r = rows[k:k + step]
            out[r] = _areas_of(_padded(e, start[r], size[r], w), _padded(shape, start[r], size[r], w), shapes)
    return out


def areas(e: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``area`` of edge sets that lie behind one another."""
    out, start = np.zeros(len(size)), np.cumsum(size) - size
    for k in np.nonzero(size > SHORT)[0]:
        out[k] = area(e[start[k]:start[k] + size[k]])
    short = np.nonzero(size <= SHORT)[0]
    for k in range(0, len(short), PAIRS):
        r = short[k:k + PAIRS]
        own = e[runs(start[r], size[r])]
        out[r] = _measured(own, np.zeros(len(own)), size[r], 1)
    return out


def shared_areas(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """``shared_area`` of pairs of edge sets, each a run of ``a`` and a run of ``b``."""
    out = np.zeros(len(a_size))
    some = np.nonzero((a_size > 0) & (b_size > 0))[0]
    for k in range(0, len(some), PAIRS):
        r = some[k:k + PAIRS]
        size = np.stack([a_size[r], b_size[r]])
        first = np.cumsum(size, axis=1) - size
        sides = a[runs(a_start[r], size[0])], b[runs(b_start[r], size[1])]
        ends = [(np.minimum.reduceat(e[:, 1], f), np.maximum.reduceat(e[:, 3], f), np.maximum.reduceat(e[:, ::2].max(axis=1), f)) for e, f in zip(sides, first)]
        low, high, right = np.maximum(ends[0][0], ends[1][0]), np.minimum(ends[0][1], ends[1][1]), np.minimum(ends[0][2], ends[1][2])
        pair = [np.repeat(np.arange(len(r)), s) for s in size]
        kept = [(e[:, 3] > low[p]) & (e[:, 1] < high[p]) & (np.minimum(e[:, 0], e[:, 2]) <= right[p]) for e, p in zip(sides, pair)]
        sides, pair = [e[m] for e, m in zip(sides, kept)], [p[m] for p, m in zip(pair, kept)]
        size = np.stack([np.bincount(p, minlength=len(r)) for p in pair])
        e, shape, at = np.concatenate(sides), np.repeat([0.0, 1.0], [len(pair[0]), len(pair[1])]), np.argsort(np.concatenate(pair), kind="stable")
        e, shape, n = e[at], shape[at], size.sum(axis=0)
        for p in np.nonzero((n > SHORT) & (size > 0).all(axis=0))[0]:
            out[r[p]] = shared_area(a[a_start[r[p]]:][:a_size[r[p]]], b[b_start[r[p]]:][:b_size[r[p]]])
        short = (n <= SHORT) & (size > 0).all(axis=0)
        held = np.repeat(short, n)
        out[r[short]] = _measured(e[held], shape[held], n[short], 2)
    return out


def covered_area(e: np.ndarray, shape: np.ndarray) -> float:
    """Area that lies in shape 0 and in at least one other."""
    total = 0.0
    for ys, k, order, x, sign in _lines(e, shape) if len(e) else ():
        own = shape[order]
        inside = (np.cumsum(np.where(own == 0, sign, 0), axis=1) == 1) & (np.cumsum(np.where(own > 0, sign, 0), axis=1) > 0)
        width = np.where(inside[:, :-1], np.diff(np.where(np.isfinite(x), x, 0), axis=1), 0).sum(axis=1)
        total += float((width * np.diff(ys[k:k + len(x) + 1])).sum())
    return total


def covered_areas(a: np.ndarray, size: np.ndarray, b: np.ndarray, row: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """``covered_area`` of edge sets ``a`` that lie behind one another, each under the shapes (1 and more) whose edges ``b`` name its ``row``."""
    out, own = np.zeros(len(size)), np.repeat(np.arange(len(size)), size)
    at = np.argsort(row, kind="stable")
    b, row, shape = b[at], row[at], shape[at]
    ends_a, ends_b = np.concatenate([[0], np.cumsum(size)]), np.searchsorted(row, np.arange(len(size) + 1))
    for k in range(0, len(size), PAIRS):
        stop = min(k + PAIRS, len(size))
        n = stop - k
        x, p = a[ends_a[k]:ends_a[stop]], own[ends_a[k]:ends_a[stop]] - k
        y, q, t = b[ends_b[k]:ends_b[stop]], row[ends_b[k]:ends_b[stop]] - k, shape[ends_b[k]:ends_b[stop]]
        low, high, right = np.full(n, np.inf), np.full(n, -np.inf), np.full(n, -np.inf)
        np.minimum.at(low, p, x[:, 1])
        np.maximum.at(high, p, x[:, 3])
        np.maximum.at(right, p, x[:, ::2].max(axis=1, initial=-np.inf))
        kept = (y[:, 3] > low[q]) & (y[:, 1] < high[q]) & (np.minimum(y[:, 0], y[:, 2]) <= right[q])  # what lies right of shape 0 bounds nothing shared
        y, q, t = y[kept], q[kept], t[kept]
        some = np.bincount(q, minlength=n) > 0
        x, p = x[some[p]], p[some[p]]
        at = np.argsort(np.concatenate([p, q]), kind="stable")
        e, kind = np.concatenate([x, y])[at], np.concatenate([np.zeros(len(x)), t])[at]
        count = np.bincount(np.concatenate([p, q]), minlength=n)
        start = np.cumsum(count) - count
        short = count <= SHORT
        for i in np.nonzero(~short)[0]:
            s = slice(start[i], start[i] + count[i])
            out[k + i] = covered_area(e[s], kind[s])
        held = np.repeat(short, count)
        out[k:stop][short] = _measured(e[held], kind[held], count[short], None)
    return out
