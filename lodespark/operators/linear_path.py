"""Penalised linear regression from sufficient statistics.

Least squares with any ridge or lasso penalty needs only the sums of products of features and target. One pass
per data set collects those sums for every fold; every fold's training set is the total minus the fold, and every
point of a penalty grid is then solved and scored from matrices of a dozen columns, without touching rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CD_ITERATIONS = 10_000
CD_TOLERANCE = 1e-12


@dataclass(frozen=True)
class Moments:
    """Count, sums and sums of products of ``[features, target]``, taken around fixed centres."""

    n: float
    total: np.ndarray
    products: np.ndarray
    centre: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.total + other.total, self.products + other.products, self.centre)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.n - other.n, self.total - other.total, self.products - other.products, self.centre)

    def covariance(self) -> np.ndarray:
        mean = self.total / self.n
        return self.products / self.n - np.outer(mean, mean)


@dataclass(frozen=True)
class LinearFit:
    coefficients: np.ndarray
    intercept: float


@dataclass(frozen=True)
class LinearModel:
    """A fit over named columns; it scores rows as one plain column expression."""

    features: list[str]
    fit: LinearFit

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [F.lit(float(w)) * F.col(f) for f, w in zip(self.features, self.fit.coefficients)]
        return df.withColumn("prediction", sum(terms, F.lit(self.fit.intercept)))


def moments_by(df: DataFrame, features: list[str], target: str, by: list[str]) -> dict[tuple, Moments]:
    """Moments for every combination of ``by``: one pass for the centres, one for the sums.

    The result has one small row per fold, so collecting it is bounded by the number of folds.
    """
    cols = [*features, target]
    centre = np.array(df.agg(*[F.avg(c).alias(c) for c in cols]).first(), dtype=float)
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, centre)]
    size = len(cols)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    rows = (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.array(*[F.sum(v) for v in x]).alias("_total"),
            F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("_products"),
        )
        .collect()
    )
    out = {}
    for r in rows:
        products = np.zeros((size, size))
        for (i, j), v in zip(upper, r._products):
            products[i, j] = products[j, i] = v
        out[tuple(r[b] for b in by)] = Moments(float(r._n), np.array(r._total), products, centre)
    return out


def solve(m: Moments, alpha: float = 0.0, l1_ratio: float | None = None) -> LinearFit:
    """Least squares (``alpha=0``), ridge (``l1_ratio=None``: penalty ``alpha |w|^2`` on the sum of squares), or
    elastic net (``alpha`` on the mean of squares: half the squares plus ``l1_ratio`` of the penalty absolute)."""
    cov = m.covariance()
    a, c = cov[:-1, :-1], cov[:-1, -1]
    if l1_ratio is None:
        ridge = a + (alpha / m.n) * np.eye(len(c))
        w = np.linalg.lstsq(ridge, c, rcond=None)[0] if alpha == 0 else np.linalg.solve(ridge, c)
    else:
        w = _coordinate_descent(a, c, alpha * l1_ratio, alpha * (1 - l1_ratio))
    mean = m.total / m.n + m.centre
    return LinearFit(w, float(mean[-1] - mean[:-1] @ w))


def _coordinate_descent(a: np.ndarray, c: np.ndarray, l1: float, l2: float) -> np.ndarray:
    w = np.zeros(len(c))
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    for _ in range(CD_ITERATIONS):
        largest = 0.0
        for j in range(len(c)):
            rest = c[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (a[j, j] + l2) if a[j, j] + l2 > 0 else 0.0
            largest = max(largest, abs(new - w[j]) * scale[j])
            w[j] = new
        if largest < CD_TOLERANCE:
            break
    return w


def fit_from_moments(
    df: DataFrame, features: list[str], target: str, alpha: float = 0.0, l1_ratio: float | None = None
) -> LinearModel:
    """Fit on all rows of ``df`` in two passes."""
    return LinearModel(features, solve(moments_by(df, features, target, [])[()], alpha, l1_ratio))


def squared_error(m: Moments, fit: LinearFit) -> float:
    """Mean squared error of a fit on the rows behind the moments."""
    w = np.append(-fit.coefficients, 1.0)
    shift = float(m.centre @ w) - fit.intercept
    return float((w @ m.products @ w + 2 * shift * (m.total @ w)) / m.n + shift * shift)


def cv_errors(folds: dict[tuple, Moments], settings: list[dict]) -> list[list[float]]:
    """Held-out error of every setting (keyword arguments of :func:`solve`) on every fold."""
    whole = None
    for m in folds.values():
        whole = m if whole is None else whole + m
    held_out = [folds[k] for k in sorted(folds)]
    return [[squared_error(f, solve(whole - f, **s)) for f in held_out] for s in settings]
