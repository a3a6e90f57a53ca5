"""Two-sided p-values for already aggregated statistics (a handful of rows)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Largest sample for which the signed-rank distribution is counted out.
EXACT_WILCOXON_N = 50


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) by Gauss-Legendre quadrature of the density in the angle ``atan(t / sqrt(df))``.

    With that substitution the density is ``cos(theta) ** (df - 1)`` on a bounded interval.
    """
    if not (math.isfinite(df) and df > 0) or math.isnan(t):
        return math.nan
    nodes, weights = np.polynomial.legendre.leggauss(200)

    def integral(lo: float) -> float:
        theta = lo + (math.pi / 2 - lo) * (nodes + 1) / 2
        return float((weights * np.cos(theta) ** (df - 1)).sum() * (math.pi / 2 - lo) / 2)

    return min(1.0, integral(math.atan2(abs(t), math.sqrt(df))) / integral(0.0))


def signed_rank_exact(w: float, n: int) -> float:
    """P-value of ``min(W+, W-) = w`` when no difference is zero and no two are tied in size."""
    ways = np.ones(1)
    for rank in range(1, n + 1):
        ways = np.concatenate([ways, np.zeros(rank)]) + np.concatenate([np.zeros(rank), ways])
    return min(1.0, 2.0 * float(ways[: int(w) + 1].sum()) / 2.0**n)


def signed_rank_normal(w: float, n: int, tie_term: float) -> float:
    """Normal approximation; ``tie_term`` is the sum of ``t^3 - t`` over groups of tied sizes."""
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else math.nan


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_t_two_sided(float(a), float(b)) for a, b in zip(t, df)])


@pandas_udf(DoubleType())
def signed_rank_pvalue(w: pd.Series, n: pd.Series, n_zero: pd.Series, tie_term: pd.Series) -> pd.Series:
    def one(w: float, n: float, zeros: float, ties: float) -> float:
        if not n > 0 or math.isnan(w):
            return math.nan
        exact = n <= EXACT_WILCOXON_N and zeros == 0 and ties == 0
        return signed_rank_exact(w, int(n)) if exact else signed_rank_normal(w, int(n), ties)

    return pd.Series([one(*map(float, row)) for row in zip(w, n, n_zero, tie_term)])
