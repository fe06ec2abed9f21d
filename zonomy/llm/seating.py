"""Chinese-restaurant seating of many cells at once.

A cell is one dish in one restaurant: ``c`` customers at tables of given sizes. ``table_counts`` seats all customers
of all cells anew in one step; only the number of tables is drawn, for nothing else enters the model. ``Seating``
takes one random customer of every cell from its table and seats it anew, in lockstep: the same law, step by step.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Customers up to which table counts are drawn from their exact law; numbers held at once while drawing.
EXACT, CHUNK = 256, 2_000_000


@cache
def _log_weights(discount: float) -> list[np.ndarray]:
    """For c customers the log weights of 1 to c tables, summed over all seatings: generalised Stirling numbers."""
    rows = [np.empty(0), np.zeros(1)]
    for c in range(1, EXACT):
        more = np.full(c + 1, -np.inf)
        more[:c] = rows[-1] + np.log(c - discount * np.arange(1, c + 1))
        more[1:] = np.logaddexp(more[1:], rows[-1])
        rows.append(more)
    return rows


def _many(c: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Table counts of large cells. The law is that of a Poisson number of tables whose sizes have the generating function
    g(x) = (1 - (1 - x)^d) / d, given that they add up to c; x is set so that c is their mean."""
    low, high = np.full(len(c), -2000.0), np.full(len(c), -1e-15)  # log(1 - x)
    for _ in range(70):
        s = (low + high) / 2
        above = np.log(fresh) + np.log(-np.expm1(s)) + (discount - 1) * s > np.log(c)
        low, high = np.where(above, s, low), np.where(above, high, s)
    s = (low + high) / 2
    mean = -fresh * np.expm1(discount * s) / discount
    var = np.maximum(mean - c / (1 - (1 - discount) * np.expm1(s) * np.exp(np.minimum(-s, 700))), 0)
    wide = mean + var / np.maximum(mean, 1e-300) + np.sqrt(var) * rng.standard_normal(len(c))
    few = mean <= 50  # one table takes nearly all
    t = np.where(few, 1 + rng.poisson(np.where(few, mean, 0)), np.rint(wide))
    return np.clip(t, 1, c).astype(np.int64)


def table_counts(c: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells of ``c`` customers when all are seated anew and a new table weighs ``fresh`` against the size less
    the discount of an old one. Exact up to EXACT customers, normal or Poisson about the mean beyond."""
    t = np.minimum(c, 1).astype(np.int64)
    for n in np.unique(c[(c > 1) & (c <= EXACT)]):
        cells, weights, k = np.flatnonzero(c == n), _log_weights(discount)[n], np.arange(1, n + 1)
        for at in range(0, len(cells), max(1, CHUNK // n)):
            own = cells[at:at + max(1, CHUNK // n)]
            p = weights + np.log(fresh[own])[:, None] * k
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            t[own] = 1 + (rng.random(len(own))[:, None] * p[:, -1:] >= p).sum(axis=1)
    big = np.flatnonzero(c > EXACT)
    t[big] = _many(c[big], fresh[big], discount, rng)
    return np.minimum(t, c)


class Seating:
    """Table sizes of cells in one array; every cell has room for some further tables."""

    def __init__(self, sizes: np.ndarray, tables: np.ndarray, room: np.ndarray) -> None:
        self.start = np.concatenate([[0], np.cumsum(tables + room)])
        self.tables = tables.astype(np.int64)
        self.used = self.tables.copy()
        self.slot = np.zeros(self.start[-1], np.int64)
        own = np.repeat(np.arange(len(tables)), tables)
        first = np.cumsum(tables) - tables
        self.slot[self.start[own] + np.arange(len(own)) - first[own]] = sizes
        self.customers = np.add.reduceat(np.append(self.slot, 0), self.start[:-1]) * (np.diff(self.start) > 0) if len(tables) else np.empty(0, np.int64)

    def _pick(self, cells: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The table of a random customer of each cell."""
        total = np.concatenate([[0], np.cumsum(self.slot)])
        at = total[self.start[cells]] + (rng.random(len(cells)) * self.customers[cells]).astype(np.int64)
        return np.searchsorted(total, at, side="right") - 1

    def leave(self, cells: np.ndarray, rng: np.random.Generator) -> None:
        """A random customer of each of the (distinct) cells leaves; an empty table is removed."""
        at = self._pick(cells, rng)
        self.slot[at] -= 1
        self.tables[cells] -= self.slot[at] == 0
        self.customers[cells] -= 1

    def enter(self, cells: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """One customer enters each of the (distinct) cells; ``fresh`` is the weight of a new table."""
        c, t = self.customers[cells], self.tables[cells]
        new = rng.random(len(cells)) * (fresh + c - discount * t) < fresh
        new |= c == 0
        opened = cells[new]
        self.slot[self.start[opened] + self.used[opened]] = 1
        self.used[opened] += 1
        self.tables[opened] += 1
        waiting = cells[~new]
        seats: list[np.ndarray] = []
        while len(waiting):  # a table is taken in proportion to its size less the discount
            at = self._pick(waiting, rng)
            fits = rng.random(len(waiting)) * self.slot[at] >= discount
            seats.append(at[fits])
            waiting = waiting[~fits]
        if seats:
            self.slot[np.concatenate(seats)] += 1
        self.customers[cells] += 1

    def sweep(self, fresh: np.ndarray, discount: float, steps: int, rng: np.random.Generator) -> None:
        """Reseats up to ``steps`` customers of every cell that has a choice."""
        for step in range(steps):
            cells = np.flatnonzero((self.customers > 1) & (self.customers > step))
            if not len(cells):
                return
            self.leave(cells, rng)
            self.enter(cells, fresh[cells], discount, rng)

    def shift(self, goal: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Customers enter or leave until every cell has ``goal`` of them."""
        while len(cells := np.flatnonzero(self.customers > goal)):
            self.leave(cells, rng)
        while len(cells := np.flatnonzero(self.customers < goal)):
            self.enter(cells, fresh[cells], discount, rng)

    def sizes(self) -> np.ndarray:
        return self.slot[self.slot > 0]
