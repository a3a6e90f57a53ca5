"""Kernel regression with the epsilon-insensitive loss, on landmark features.

A fixed number of landmark rows spans the kernel space (Nystroem); within it the loss is minimised by weighted
least squares whose statistics are summed over the data, one pass per step. It approximates the dual solution of a
support vector machine and scales with the rows, not their square.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodespark.operators.blocks import numeric_blocks, sum_over

LANDMARKS = 128
STEPS = 30
# Residual excess below which the weight of a row stops growing.
MIN_EXCESS = 1e-3
STEP_SIZES = [1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.0]


def kernel_matrix(kind: str, x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """Gaussian, cubic or hyperbolic-tangent kernel between two sets of rows."""
    if kind == "rbf":
        dist = (x**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * x @ z.T
        return np.exp(-gamma * np.maximum(dist, 0.0))
    if kind == "poly":
        return (gamma * x @ z.T) ** 3
    if kind == "sigmoid":
        return np.tanh(gamma * x @ z.T)
    raise ValueError(f"unknown kernel: {kind}")


@dataclass(frozen=True)
class KernelModel:
    """Fitted weights over the landmarks."""

    features: list[str]
    kind: str
    gamma: float
    landmarks: np.ndarray
    weights: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return kernel_matrix(self.kind, x, self.landmarks, self.gamma) @ self.weights + self.intercept

    def transform(self, df: DataFrame) -> DataFrame:
        predict = self.predict

        @F.pandas_udf("double")
        def kernel_predict(*cols: pd.Series) -> pd.Series:
            return pd.Series(predict(np.column_stack([c.to_numpy(float) for c in cols])))

        return df.withColumn("prediction", kernel_predict(*self.features))


@dataclass
class _Design:
    """What the fits of one training set and kernel share: width, landmarks and the way into their space."""

    left_out: int
    kind: str
    gamma: float
    marks: np.ndarray
    to_space: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        phi = kernel_matrix(self.kind, x, self.marks, self.gamma) @ self.to_space
        return np.column_stack([phi, np.ones(len(phi))])


@dataclass
class _Fit:
    design: int
    c: float
    epsilon: float
    theta: np.ndarray
    running: bool = True


def _training_sets(folds: DataFrame, features: list[str], target: str, outs: list[int], landmarks: int) -> list[tuple]:
    """(gamma, landmark rows, target mean) of the rows outside each fold of ``outs``: two jobs for all.

    The width is ``1 / (p * var(X))`` over all cells. Landmarks are the first different rows in hash order.
    """
    p = len(features)
    sums = folds.groupBy("_fold").agg(
        F.count(F.lit(1)), F.sum(target), *[F.sum(c) for c in features], *[F.sum(F.col(c) * F.col(c)) for c in features]
    )
    stats = {r[0]: np.array(r[1:], float) for r in sums.collect()}
    order = [F.xxhash64(*features), *features]
    first = (
        folds.select("_fold", *features)
        .distinct()
        .withColumn("_place", F.row_number().over(W.partitionBy("_fold").orderBy(*order)))
        .where(F.col("_place") <= landmarks)
        .select("_fold", F.xxhash64(*features).alias("_hash"), *features)
        .collect()
    )
    rows = sorted((r["_hash"], tuple(float(r[c]) for c in features), r["_fold"]) for r in first)
    out = []
    for left_out in outs:
        n, total, *cells = sum(v for f, v in stats.items() if f != left_out)
        mean, square = np.array(cells[:p]) / n, np.array(cells[p:]) / n
        spread = float((square - mean**2).mean() + mean.var())
        different = list(dict.fromkeys(x for _, x, f in rows if f != left_out))[:landmarks]
        marks = np.unique(np.array(different), axis=0)
        out.append((1.0 / (p * spread) if spread > 0 else 1.0, marks, total / n))
    return out


def fit_kernels(
    folds: DataFrame,
    features: list[str],
    target: str,
    settings: list[dict],
    outs: list[int],
    landmarks: int = LANDMARKS,
    steps: int = STEPS,
) -> list[list[KernelModel]]:
    """Models of every setting (C, epsilon, kernel) on the rows outside every fold of ``outs``, column ``_fold``.

    Each minimises ``|w|^2 / 2 + C * sum(max(0, |residual| - epsilon))`` over its landmark features. All fits take
    their steps in the same two passes over the rows, so jobs grow with steps and not with fits. A fit stops when no
    step size lowers its loss.
    """
    designs, fits = [], []
    for left_out, (gamma, marks, mean) in zip(outs, _training_sets(folds, features, target, outs, landmarks)):
        place = {}
        for kind in dict.fromkeys(s["kernel"] for s in settings):
            values, vectors = np.linalg.eigh(kernel_matrix(kind, marks, marks, gamma))
            solid = values > max(values.max(), 0.0) * 1e-10
            if not solid.any():
                raise ValueError("the kernel vanishes on all landmarks")
            place[kind] = len(designs)
            designs.append(_Design(left_out, kind, gamma, marks, vectors[:, solid] / np.sqrt(values[solid])))
        for s in settings:
            design = place[s["kernel"]]
            theta = np.zeros(designs[design].to_space.shape[1] + 1)
            theta[-1] = mean
            fits.append(_Fit(design, s["C"], s["epsilon"], theta))

    def over_fits(block: np.ndarray, jobs: list, each) -> np.ndarray:
        """``each(columns, y, job)`` of all jobs, the columns of a design made once per block."""
        parts, made = [], {}
        for job in jobs:
            if job[0] not in made:
                rows = block[block[:, 0] != designs[job[0]].left_out]
                made = {job[0]: (designs[job[0]].columns(rows[:, 1:-1]), rows[:, -1])}
            parts.append(each(*made[job[0]], job))
        return np.concatenate(parts)

    def equations(phi: np.ndarray, y: np.ndarray, job: tuple) -> np.ndarray:
        _, c, epsilon, theta = job
        residual = y - phi @ theta
        excess = np.abs(residual) - epsilon
        weight = np.where(excess > 0, c / np.maximum(excess, MIN_EXCESS), 0.0)
        left = phi.T @ (phi * weight[:, None])
        return np.concatenate([left.ravel(), phi.T @ (weight * (y - np.sign(residual) * epsilon))])

    def losses(phi: np.ndarray, y: np.ndarray, job: tuple) -> np.ndarray:
        _, c, epsilon, tries = job
        return c * np.array([np.maximum(np.abs(y - phi @ t) - epsilon, 0).sum() for t in tries])

    blocks = numeric_blocks(folds, ["_fold", *features], target)
    try:
        for _ in range(steps):
            active = [f for f in fits if f.running]
            if not active:
                break
            jobs = [(f.design, f.c, f.epsilon, f.theta) for f in active]
            sizes = [len(f.theta) for f in active]
            sums = sum_over(blocks, lambda b, jobs=jobs: over_fits(b, jobs, equations), sum(n * n + n for n in sizes))
            tried, at = [], 0
            for f, n in zip(active, sizes):
                left, right = sums[at : at + n * n].reshape(n, n), sums[at + n * n : at + n * n + n]
                at += n * n + n
                penalty = np.eye(n)
                penalty[-1, -1] = 1e-10
                goal = np.linalg.solve(left + penalty, right + penalty @ (f.theta * np.eye(n)[-1]))
                tried.append([f.theta + s * (goal - f.theta) for s in STEP_SIZES])
            jobs = [(f.design, f.c, f.epsilon, tries) for f, tries in zip(active, tried)]
            totals = sum_over(blocks, lambda b, jobs=jobs: over_fits(b, jobs, losses), len(active) * len(STEP_SIZES))
            for f, tries, total in zip(active, tried, totals.reshape(len(active), -1)):
                total = total + [0.5 * float(t[:-1] @ t[:-1]) for t in tries]
                best = int(np.argmin(total))
                f.theta = tries[best]
                f.running = total[-1] - total[best] > 1e-7 * max(1.0, total[-1])
    finally:
        blocks.unpersist()

    def model(f: _Fit) -> KernelModel:
        d = designs[f.design]
        return KernelModel(features, d.kind, d.gamma, d.marks, d.to_space @ f.theta[:-1], float(f.theta[-1]))

    models = [model(f) for f in fits]
    return [models[i : i + len(settings)] for i in range(0, len(models), len(settings))]


def fit_kernel(
    df: DataFrame,
    features: list[str],
    target: str,
    c: float = 1.0,
    epsilon: float = 0.1,
    kernel: str = "rbf",
    landmarks: int = LANDMARKS,
    steps: int = STEPS,
) -> KernelModel:
    """One fit on all rows of ``df``."""
    rows = df.select(*features, target).withColumn("_fold", F.lit(0))
    setting = {"C": c, "epsilon": epsilon, "kernel": kernel}
    return fit_kernels(rows, features, target, [setting], [-1], landmarks, steps)[0][0]


def kernel_cv_errors(
    folds: DataFrame, features: list[str], target: str, settings: list[dict], k: int
) -> list[list[float]]:
    """Mean squared error of every setting on every fold (1..k), fitted on the others; one pass scores all."""
    rows = folds.withColumn("_fold", F.col("fold"))
    models = fit_kernels(rows, features, target, settings, list(range(1, k + 1)))

    def squares(block: np.ndarray) -> np.ndarray:
        out = np.zeros((k, len(settings) + 1))
        for f in range(k):
            mine = block[block[:, 0] == f + 1]
            out[f] = [*[((m.predict(mine[:, 1:-1]) - mine[:, -1]) ** 2).sum() for m in models[f]], len(mine)]
        return out.ravel()

    blocks = numeric_blocks(rows, ["_fold", *features], target)
    try:
        total = sum_over(blocks, squares, k * (len(settings) + 1)).reshape(k, -1)
    finally:
        blocks.unpersist()
    return (total[:, :-1] / np.maximum(total[:, -1:], 1)).T.tolist()
