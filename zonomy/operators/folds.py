"""Leave-one-city-out stacking: one multinomial regression per left-out city, all fitted together.

Every pass over the rows serves all folds that have not settled: a row adds to the loss and gradient of each fold but that of its own
city. Second moments are summed once by city, and a fold's are the total minus its city's; they shape its steps, which are
quasi-Newton steps with halving. The driver holds the coefficients and a short history per fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from zonomy.functions.common import N_CLASSES
from zonomy.operators.confusion import confusion_counts, summary_scores
from zonomy.session import cut_lineage

#: Steps remembered per fold.
HISTORY = 12


class Fold:
    """Coefficients (class by feature, the last feature is the constant) of one fold and its quasi-Newton history."""

    def __init__(self, city: str, shape: tuple[int, int], moments: np.ndarray, lam: float):
        self.city, self.w, self.done = city, np.zeros(shape), False
        penalty = np.full(shape[1], lam)
        penalty[-1] = 0.0
        self.scale = np.linalg.pinv(moments / shape[0] + np.diag(penalty + 1e-9))
        self.loss, self.grad, self.pairs = np.inf, None, []
        self.step, self.way, self.trial = 1.0, None, self.w

    def direction(self) -> np.ndarray:
        q, alphas = self.grad.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s * q).sum()
            alphas.append(a)
            q -= a * y
        gamma = 1.0
        if self.pairs:
            s, y, _ = self.pairs[-1]
            gamma = (s * y).sum() / (y * (y @ self.scale)).sum()
        r = gamma * (q @ self.scale)
        for (s, y, rho), a in zip(self.pairs, reversed(alphas)):
            r += s * (a - rho * (y * r).sum())
        return -r

    def take(self, loss: float, grad: np.ndarray, tolerance: float) -> None:
        """Judge the trial point and set the next one."""
        if self.grad is not None:
            slope = (self.grad * self.way).sum()
            if not loss <= self.loss + 1e-4 * self.step * slope + 1e-14 * abs(self.loss):
                self.step /= 2
                if self.step < 1e-10:
                    raise RuntimeError(f"the fold without {self.city} cannot lower its loss")
                self.trial = self.w + self.step * self.way
                return
            s, y = self.trial - self.w, grad - self.grad
            if (s * y).sum() > 1e-16:
                self.pairs = [*self.pairs, (s, y, 1 / (s * y).sum())][-HISTORY:]
        self.w, self.loss, self.grad = self.trial, loss, grad
        self.done = float(np.abs(grad).max()) <= tolerance
        self.step, self.way = 1.0, self.direction()
        self.trial = self.w + self.way


def _features(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.stack(pdf["x"].to_numpy()), np.ones(len(pdf))])


def _moments(rows: DataFrame, width: int) -> dict[str, tuple[float, np.ndarray]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for city, own in pdf.groupby("city"):
                x = _features(own)
                m = (x.T @ x).ravel()
                yield pd.DataFrame({"city": city, "i": np.arange(m.size + 1), "v": np.append(m, len(own))})

    got = rows.mapInPandas(run, "city string, i int, v double").groupBy("city", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for city, own in got.groupby("city"):
        v = own.sort_values("i")["v"].to_numpy()
        out[city] = (v[-1], v[:-1].reshape(width, width))
    return out


def fit_folds(rows: DataFrame, lam: float, tolerance: float = 1e-7, passes: int = 400) -> dict[str, np.ndarray]:
    """Coefficients per left-out city of the fit on (x array, y from 0, city): mean cross entropy plus lam / 2 times the square of
    all coefficients but the constants. Ends when every gradient is within the tolerance and fails if ``passes`` do not get there.
    """
    rows = cut_lineage(rows.select("x", "y", F.col("city").cast("string").alias("city")).where(F.col("city").isNotNull()))
    first = rows.first()
    if first is None:
        return {}
    width = len(first["x"]) + 1
    by_city = _moments(rows, width)
    n, total = sum(v[0] for v in by_city.values()), sum(v[1] for v in by_city.values())
    folds = [Fold(c, (N_CLASSES, width), (total - m) / max(n - k, 1), lam) for c, (k, m) in sorted(by_city.items())]
    count = {c: max(n - k, 1) for c, (k, _) in by_city.items()}

    for _ in range(passes):
        open_ = [f for f in folds if not f.done]
        if not open_:
            return {f.city: f.w for f in folds}
        names, trials = [f.city for f in open_], np.stack([f.trial for f in open_])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(names), trials[0].size + 1))
            for pdf in batches:
                x, y, city = _features(pdf), pdf["y"].to_numpy(), pdf["city"].to_numpy()
                for k, (name, w) in enumerate(zip(names, trials)):
                    keep = city != name
                    xk, yk = x[keep], y[keep]
                    z = xk @ w.T
                    z -= z.max(axis=1, keepdims=True)
                    e = np.exp(z)
                    t = e.sum(axis=1, keepdims=True)
                    sums[k, -1] += (np.log(t[:, 0]) - z[np.arange(len(yk)), yk]).sum()
                    e /= t
                    e[np.arange(len(yk)), yk] -= 1
                    sums[k, :-1] += (e.T @ xk).ravel()
            k, i = np.indices(sums.shape)
            yield pd.DataFrame({"k": k.ravel(), "i": i.ravel(), "v": sums.ravel()})

        got = rows.mapInPandas(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).orderBy("k", "i").toPandas()
        sums = got["v"].to_numpy().reshape(len(names), -1)
        for f, v in zip(open_, sums):
            free = f.trial.copy()
            free[:, -1] = 0
            f.take(v[-1] / count[f.city] + lam / 2 * float((free * free).sum()), v[:-1].reshape(f.w.shape) / count[f.city] + lam * free, tolerance)
    raise RuntimeError(f"the folds did not settle in {passes} passes")


def predict_folds(rows: DataFrame, folds: dict[str, np.ndarray], keep: tuple[str, ...] = ("id", "city", "label")) -> DataFrame:
    """(keep, pred): every row by the fit that left its city out; cities without a fit are left out. Ties go to the lower class."""
    shared = rows.sparkSession.sparkContext.broadcast(folds)  # classes by features per city
    d = rows.select(*keep, "x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for city, own in pdf.groupby("city"):
                if city in shared.value:
                    z = np.round(_features(own) @ shared.value[city].T, 9)
                    yield own[list(keep)].assign(pred=z.argmax(axis=1).astype("int32") + 1)

    return d.mapInPandas(run, f"{schema}, pred int")


def stacked_leave_city_out(wide: DataFrame, lam: float = 1e-3, fit: str = "val", test: str = "test") -> DataFrame:
    """(id, city, label, pred) of the test rows, each predicted by the stacking that never saw its city. ``wide`` is the table of
    ``ensemble.side_by_side``; the features are the models' probabilities."""
    d = wide.select("id", "label", F.col("city").cast("string").alias("city"), "split", F.flatten("p").alias("x"), (F.col("label") - 1).cast("int").alias("y"))
    folds = fit_folds(d.where(F.col("split") == fit), lam)
    return predict_folds(d.where(F.col("split") == test), folds)


def city_kappas(predicted: DataFrame) -> DataFrame:
    """Scores per city."""
    return summary_scores(confusion_counts(predicted, "label", "pred", ["city"]), ["city"])
