"""Convex hulls and smallest enclosing rectangles of point arrays, as Arrow functions of columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from zonomy.functions.common import col

POINTS = "array<struct<x:double,y:double>>"
RECTANGLE = "struct<long:double,short:double>"
FEW = 64  # points that are sorted as Python numbers, which numpy takes longer for


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The finite points of every row."""
    flat = column.flatten()
    xy = np.stack([np.asarray(flat.field(k).to_numpy(zero_copy_only=False), np.float64) for k in ("x", "y")], axis=1) if len(flat) else np.empty((0, 2))
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
    for a, b in zip(ends[:-1], ends[1:]):
        p = xy[a:b]
        yield p[np.isfinite(p).all(axis=1)]


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the hull by monotone chains, counter-clockwise from the lowest x; points on a side are left out."""
    rows = sorted(set(map(tuple, points.tolist()))) if len(points) <= FEW else np.unique(points, axis=0).tolist()
    if len(rows) < 3:
        return np.array(rows, float).reshape(-1, 2)

    def chain(order: list) -> list[list[float]]:
        out: list[list[float]] = []
        for x, y in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append([x, y])
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def rectangle_of(hull: np.ndarray) -> tuple[float, float]:
    """(long, short) side of the enclosing rectangle of least area; one of its sides lies on a side of the hull.

    Calipers: as the side turns, the farthest corners ahead, across and behind only move on.
    """
    n = len(hull)
    if n < 3:
        return (float(np.hypot(*(hull[1] - hull[0]))) if n == 2 else 0.0), 0.0
    h = hull.tolist()
    sides = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(h, h[1:] + h[:1])]
    unit = [(x / math.hypot(x, y), y / math.hypot(x, y)) for x, y in sides]
    dot = lambda k, u: h[k % n][0] * u[0] + h[k % n][1] * u[1]
    best, ahead, top, behind = None, 1, 1, 1
    for i, (ux, uy) in enumerate(unit):
        u, v = (ux, uy), (-uy, ux)
        ahead = max(ahead, i + 1)
        while dot(ahead + 1, u) > dot(ahead, u):
            ahead += 1
        top = max(top, ahead)
        while dot(top + 1, v) > dot(top, v):
            top += 1
        behind = max(behind, top)
        while dot(behind + 1, u) < dot(behind, u):
            behind += 1
        w, d = dot(ahead, u) - dot(behind, u), dot(top, v) - dot(i, v)
        if best is None or w * d < best[0]:
            best = (w * d, max(w, d), min(w, d))
    return best[1], best[2]


def convex_hull(points: Column | str) -> Column:
    """Corners of the hull. The hull of several parts is the hull of their hulls' points. Points with missing or non-finite
    coordinates are left out; a null row gives an empty hull."""
    @F.arrow_udf(POINTS)
    def hull(column: pa.Array) -> pa.Array:
        made = [hull_of(p) for p in _rows(column)]
        flat = np.concatenate([*made, np.empty((0, 2))])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in made])]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"]))

    return hull(col(points).cast(POINTS))


def smallest_rectangle(points: Column | str) -> Column:
    """struct<long, short> of the smallest enclosing rectangle of points in any direction; two points give their
    distance and 0, fewer give 0 and 0."""
    @F.arrow_udf(RECTANGLE)
    def sides(column: pa.Array) -> pa.Array:
        made = np.array([rectangle_of(hull_of(p)) for p in _rows(column)], float).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["long", "short"])

    return sides(col(points).cast(POINTS))


def elongation_of(rectangle: Column) -> Column:
    """1 - short / long side; 0 without extent."""
    return F.when(rectangle["long"] > 0, 1 - rectangle["short"] / rectangle["long"]).otherwise(0.0)
