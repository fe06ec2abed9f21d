"""Classical models on vector tables. Spark does the sums over rows; the driver holds only
parameters (classes x components x channels)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions import vectors as V
from zonomy.functions.common import stable_fraction
from zonomy.operators.vectors import gram, gram_matrix, covariance

FLOOR = -1e30


@dataclass
class Mixture:
    """Diagonal mixtures of all classes: one entry per (class, component)."""

    cls: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    log_prior: np.ndarray
    whiten: tuple[np.ndarray, np.ndarray] | None = None

    def log_components(self, x: np.ndarray) -> np.ndarray:
        """(rows, components): log weight plus log density."""
        inv = 1.0 / self.var
        quad = (x * x) @ inv.T - 2 * x @ (self.mean * inv).T + np.sum(self.mean * self.mean * inv, axis=1)
        norm = np.sum(np.log(2 * np.pi * self.var), axis=1)
        return np.log(np.maximum(self.weight, 1e-300)) - 0.5 * (quad + norm)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x if self.whiten is None else (x - self.whiten[0]) @ self.whiten[1].T


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype("float64")


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def _em_sums(df: DataFrame, model: Mixture, cls: str) -> pd.DataFrame:
    """Sufficient sums per component, added up in Spark: weight, moments about the component's mean, log likelihood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, d = model.mean.shape
        s0, s1, s2, ll, n = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0, 0
        for pdf in batches:
            x, y = model.project(_stack(pdf["v"])), pdf["y"].to_numpy()
            lc = model.log_components(x)
            lc[y[:, None] != model.cls[None, :]] = -np.inf
            ok = np.isfinite(lc).any(axis=1)
            x, lc = x[ok], lc[ok]
            if not len(x):
                continue
            total = _log_sum(lc)
            r = np.exp(lc - total[:, None])
            s0 += r.sum(axis=0)
            for j in range(k):  # about the present mean, so that large values do not cancel
                c = x - model.mean[j]
                s1[j] += r[:, j] @ c
                s2[j] += r[:, j] @ (c * c)
            ll, n = ll + total.sum(), n + len(x)
        yield pd.DataFrame({
            "comp": np.repeat(np.arange(k), d), "ch": np.tile(np.arange(d), k), "s0": np.repeat(s0, d),
            "s1": s1.ravel(), "s2": s2.ravel(), "ll": ll, "n": float(n)})

    rows = df.select(V.doubles("v").alias("v"), F.col(cls).alias("y")).mapInPandas(
        run, "comp int, ch int, s0 double, s1 double, s2 double, ll double, n double")
    return rows.groupBy("comp", "ch").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "ll", "n")]).orderBy("comp", "ch").toPandas()


def fit_mixtures(df: DataFrame, cls: str, components: int = 1, reg: float = 1e-4, prior: str = "uniform",
                 pca_dim: int = 0, max_rounds: int = 500, tol: float = 1e-3) -> Mixture:
    """One diagonal Gaussian mixture per class with at least two rows.

    A class gets min(components, max(1, n // 10)) components. With one component the fit is a
    single pass; otherwise components start spread along the widest channel and are
    refined by expectation maximisation, one Spark pass per round. ``df`` needs ``v``.
    """
    d = df.where(F.col(cls) >= 0).select(F.col(cls).alias("y"), V.doubles("v").alias("v"))
    whiten = None
    if pca_dim:
        mean, cov = covariance(gram_matrix(gram(d, F.col("v"))))
        value, axes = np.linalg.eigh(cov)
        top = np.argsort(value)[::-1][:pca_dim]
        whiten = (mean, axes[:, top].T / np.sqrt(value[top])[:, None])
    counts = {r["y"]: r["n"] for r in d.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    classes = sorted(c for c, n in counts.items() if n >= 2)
    dim = pca_dim or len(d.select("v").first()["v"])
    one = Mixture(np.array(classes), np.ones(len(classes)), np.zeros((len(classes), dim)), np.ones((len(classes), dim)),
                  np.zeros(len(classes)), whiten)
    mean, var = np.zeros((len(classes), dim)), None
    for _ in range(2):  # means first, then variances about them
        one.mean = mean
        mean, var, _ = _moved(_em_sums(d, one, "y"), one)
    prior_of = {c: (np.log(counts[c] / total) if prior == "empirical" else 0.0) for c in classes}
    cls_, w_, m_, v_ = [], [], [], []
    for i, c in enumerate(classes):
        k = min(components, max(1, counts[c] // 10))
        wide = int(var[i].argmax())
        for j in range(k):
            centre = mean[i].copy()
            centre[wide] += np.sqrt(var[i, wide]) * (2 * (j + 0.5) / k - 1)
            cls_.append(c), w_.append(1 / k), m_.append(centre), v_.append(var[i] + reg)
    model = Mixture(np.array(cls_), np.array(w_), np.array(m_), np.array(v_), np.array([prior_of[c] for c in cls_]), whiten)
    if len(model.cls) == len(classes):
        return model
    last = -np.inf
    for _ in range(max_rounds):
        s = _em_sums(d, model, "y")
        model.mean, var, n0 = _moved(s, model)
        model.var = var + reg
        model.weight = n0[:, 0] / np.array([n0[model.cls == c, 0].sum() for c in model.cls])
        ll = s["ll"].iloc[0] / s["n"].iloc[0]
        if abs(ll - last) < tol:
            break
        last = ll
    else:
        raise RuntimeError(f"the mixtures did not settle in {max_rounds} rounds")
    return model


def _moved(s: pd.DataFrame, model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New means, variances and weights from the sums about the old means."""
    n0, s1, s2 = (s[c].to_numpy().reshape(model.mean.shape) for c in ("s0", "s1", "s2"))
    n0 = np.maximum(n0, 1e-10)
    shift = s1 / n0
    return model.mean + shift, np.maximum(s2 / n0 - shift**2, 0.0), n0


def predict_mixtures(df: DataFrame, model: Mixture, key: str, n_classes: int) -> DataFrame:
    """(key, pred, log_joint): the class of highest log density plus log prior, -1 without any fitted class."""
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lc = model.log_components(model.project(_stack(pdf["v"])))
            joint = np.full((len(pdf), n_classes), FLOOR)
            for c in sorted(set(model.cls.tolist())):
                m = model.cls == c
                joint[:, c] = _log_sum(lc[:, m]) + model.log_prior[m][0]
            pred = joint.argmax(axis=1) if len(model.cls) else np.full(len(pdf), -1)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "pred": pred.astype("int32"), "log_joint": joint.max(axis=1)})

    return df.select(key, V.doubles("v").alias("v")).mapInPandas(run, f"{key} {key_type}, pred int, log_joint double")


# ── logistic models ──────────────────────────────────────────────────────────


def linear_probe(df: DataFrame, fit: Column, label: str = "label", vec: str = "v", max_iter: int = 1000, reg: float = 0.0) -> DataFrame:
    """Multinomial regression on standardised vectors fitted on the fit rows; adds ``pred``."""
    d = df.withColumn("_x", array_to_vector(V.doubles(vec))).withColumn("_y", F.col(label).cast("double")).withColumn("_fit", fit)
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(d.where("_fit"))
    z = scaler.transform(d)
    model = LogisticRegression(featuresCol="_z", labelCol="_y", family="multinomial", maxIter=max_iter, regParam=reg).fit(z.where("_fit"))
    out = model.transform(z)
    return out.select(*df.columns, F.col("prediction").cast("int").alias("pred"))


def domain_auc(df: DataFrame, key: str, is_test: Column, vec: str = "v", folds: int = 5, salt: str = "fold") -> DataFrame:
    """AUC of telling test rows from train rows, mean over hash folds (0.5 means no shift)."""
    d = df.select(key, array_to_vector(V.doubles(vec)).alias("_x"), is_test.cast("double").alias("_y"),
                  F.floor(stable_fraction(key, salt) * folds).cast("int").alias("_f")).persist()
    ev = BinaryClassificationEvaluator(labelCol="_y", rawPredictionCol="rawPrediction")
    rows = []
    for f in range(folds):
        model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=1000).fit(d.where(F.col("_f") != f))
        rows.append((f, float(ev.evaluate(model.transform(d.where(F.col("_f") == f))))))
    d.unpersist()
    auc = float(np.mean([a for _, a in rows]))
    return df.sparkSession.createDataFrame([(f, a, auc) for f, a in rows], "fold int, auc double, mean_auc double")
