"""Regression metrics per model and fold, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["mse", "mae", "mre", "r2"]
# Keeps the relative error finite at a true value of zero.
RELATIVE_EPS = 1e-8


def mean_relative_error(y: Column, yhat: Column, eps: float = RELATIVE_EPS) -> Column:
    return F.avg(F.abs(y - yhat) / (F.abs(y) + F.lit(eps)))


def metric_columns(y: str = "y", yhat: str = "yhat") -> dict[str, Column]:
    """Aggregates for the four metrics; all of them combine before the shuffle.

    The spread of ``y`` comes from the population variance, which Spark merges without cancellation.
    """
    t, p = F.col(y), F.col(yhat)
    squares = F.sum((t - p) * (t - p))
    spread = F.var_pop(t) * F.count(t)
    return {
        "mse": F.avg((t - p) * (t - p)),
        "mae": F.avg(F.abs(t - p)),
        "mre": mean_relative_error(t, p),
        "r2": F.when(spread > 0, F.lit(1.0) - squares / spread).otherwise(F.when(squares == 0, F.lit(1.0)).otherwise(0.0)),
    }


def holdout_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MSE, MAE and R2 per model."""
    cols = metric_columns()
    return predictions.groupBy(*(by or ["model"])).agg(*[cols[m].alias(m) for m in ("mse", "mae", "r2")])


def fold_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four metrics per model and fold."""
    return predictions.groupBy(*(by or ["model", "fold"])).agg(*[c.alias(m) for m, c in metric_columns().items()])


def cv_summary(folds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and sample standard deviation over folds of every metric."""
    stats = [
        fn(m).alias(f"{m}_{name}") for m in METRICS for name, fn in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    return folds.groupBy(*(by or ["model"])).agg(*stats)


def win_counts(folds: DataFrame, a: str, b: str, by: list[str] | None = None, metric: str = "mse") -> DataFrame:
    """Folds in which model ``a`` (``b``) has the strictly lower metric, and ties; nothing unless folds pair up."""
    by = by or []
    side = lambda m: F.max(F.when(F.col("model") == m, F.col(metric)))
    paired = folds.where(F.col("model").isin(a, b)).groupBy(*by, "fold").agg(side(a).alias("_a"), side(b).alias("_b"))
    wins = paired.groupBy(*by).agg(
        F.count_if(F.col("_a") < F.col("_b")).alias("wins_a"),
        F.count_if(F.col("_b") < F.col("_a")).alias("wins_b"),
        F.count(F.lit(1)).alias("n_folds"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_unpaired"),
    )
    return wins.where((F.col("_unpaired") == 0) & (F.col("n_folds") > 0)).select(
        *by,
        F.lit(a).alias("model_a"),
        F.lit(b).alias("model_b"),
        "wins_a",
        "wins_b",
        (F.col("n_folds") - F.col("wins_a") - F.col("wins_b")).alias("ties"),
    )
