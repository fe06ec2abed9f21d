"""Largest inscribed circle of an even-odd polygon by square cells: the distance at a cell's centre plus half its diagonal
bounds what any point of the cell can have, so cells that cannot beat the best centre are dropped and the others quartered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells times edges that are held at once.
TABLE = 1 << 20


def signed_distance(sides: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest side (x0, y0, x1, y1), negative outside."""
    out, step = np.empty(len(p)), max(1, TABLE // max(len(sides), 1))
    a, d = sides[:, :2], sides[:, 2:] - sides[:, :2]
    length = np.maximum((d * d).sum(axis=1), 1e-300)
    for s in range(0, len(p), step):
        q = p[s:s + step, None, :] - a
        t = np.clip((q * d).sum(axis=2) / length, 0, 1)
        near = np.sqrt((((q - t[..., None] * d)) ** 2).sum(axis=2).min(axis=1))
        y = p[s:s + step, 1, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = sides[:, 0] + (y - sides[:, 1]) * d[:, 0] / d[:, 1]
        inside = (((sides[:, 1] > y) != (sides[:, 3] > y)) & (p[s:s + step, 0, None] < x)).sum(axis=1) % 2 == 1
        out[s:s + step] = np.where(inside, near, -near)
    return out


def _rounds(sides: np.ndarray) -> Iterator[tuple[float, float]]:
    """(best radius so far, bound of what is left) after every round; ends when nothing is left."""
    low, high = sides.reshape(-1, 2).min(axis=0), sides.reshape(-1, 2).max(axis=0)
    half = float((high - low).min()) / 2
    if not half > 0:
        return
    grid = [np.arange(low[k] + half, high[k] + half, 2 * half) for k in (0, 1)]
    centre, best = np.stack(np.meshgrid(*grid), axis=-1).reshape(-1, 2), 0.0
    while len(centre):
        d = signed_distance(sides, centre)
        best = max(best, float(d.max()))
        bound = d + half * np.sqrt(2)
        yield best, max(best, float(bound.max()))
        half /= 2
        centre = (centre[bound > best][:, None, :] + half * np.array([(-1, -1), (-1, 1), (1, -1), (1, 1)])).reshape(-1, 2)


def inner_radius(sides: np.ndarray, tolerance: float) -> float:
    """Radius of the largest circle inside, at most ``tolerance`` below the true one; 0 without area."""
    best = 0.0
    for best, bound in _rounds(sides):
        if bound - best <= tolerance:
            break
    return best


def wider_than(sides: np.ndarray, width: float, tolerance: float) -> bool:
    """Whether a circle of more than ``width`` across fits; decided as soon as the bounds allow, to within ``tolerance``."""
    for best, bound in _rounds(sides):
        if 2 * best > width:
            return True
        if 2 * bound <= width or bound - best <= tolerance:
            return False
    return False
