"""The eight regressors: settings, fitting and scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.operators.kernel_regression import fit_kernel
from lodespark.operators.linear_path import LinearModel, fit_from_moments
from lodespark.operators.neural_regression import fit_neural
from lodespark.operators.tree_tables import CutTrees, cut_trees
from lodespark.session import sized

# Split candidates per feature for the tree models.
TREE_BINS = 32
# Memory for the split statistics of one group of nodes.
TREE_MEMORY_MB = 512
# Spark's deepest tree, used for "no limit".
DEEPEST_TREE = 30


@dataclass(frozen=True)
class VectorModel:
    """A fitted pipeline that takes plain feature columns and leaves only ``prediction`` behind."""

    features: list[str]
    pipeline: Any

    @property
    def stage(self) -> Any:
        return self.pipeline.stages[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df).drop("_features")


@dataclass(frozen=True)
class ModelSpec:
    """Display name, untuned settings and the search grid of a model."""

    name: str
    fit: Callable[..., Any]
    defaults: dict[str, Any]
    grid: dict[str, list] = field(default_factory=dict)

    def settings(self, grid: dict[str, list] | None = None) -> list[dict[str, Any]]:
        """All points of a grid, the last name running fastest."""
        grid = self.grid if grid is None else grid
        return [dict(zip(grid, point)) for point in product(*grid.values())]


def _vector_fit(estimator: Any, df: DataFrame, features: list[str], target: str) -> VectorModel:
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    estimator = estimator.copy({estimator.featuresCol: "_features", estimator.labelCol: target})
    rows = sized(df.select(*features, target)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return VectorModel(features, Pipeline(stages=[assembler, estimator]).fit(rows))
    finally:
        rows.unpersist()


def fit_linear(df: DataFrame, features: list[str], target: str, seed: int = 0) -> LinearModel:
    return fit_from_moments(df, features, target)


def fit_ridge(df: DataFrame, features: list[str], target: str, seed: int = 0, alpha: float = 1.0) -> LinearModel:
    """Penalty ``alpha |w|^2`` on the sum of squares."""
    return fit_from_moments(df, features, target, alpha)


def fit_lasso(df: DataFrame, features: list[str], target: str, seed: int = 0, alpha: float = 1.0) -> LinearModel:
    """Penalty ``alpha |w|_1`` on half the mean of squares."""
    return fit_from_moments(df, features, target, alpha, 1.0)


def fit_elasticnet(
    df: DataFrame, features: list[str], target: str, seed: int = 0, alpha: float = 0.1, l1_ratio: float = 0.5
) -> LinearModel:
    """Penalty ``alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2)`` on half the mean of squares."""
    return fit_from_moments(df, features, target, alpha, l1_ratio)


def fit_forest(
    df: DataFrame,
    features: list[str],
    target: str,
    seed: int = 0,
    n_estimators: int = 200,
    max_depth: int | None = 15,
    min_samples_leaf: int = 1,
    min_samples_split: int = 2,
    bootstrap: bool = True,
) -> VectorModel | CutTrees:
    """Forest in which every split considers all features; ``bootstrap=False`` takes all rows in every tree.

    Nodes of fewer than ``min_samples_split`` drawn rows stay whole: Spark grows them, and the trees are cut there.
    """
    model = _vector_fit(forest(seed, n_estimators, max_depth, min_samples_leaf, bootstrap), df, features, target)
    if min_samples_split <= max(2, min_samples_leaf):
        return model
    return cut_trees(model, df.sparkSession, True, None, min_samples_split)


def forest(
    seed: int, n_estimators: int, max_depth: int | None, min_samples_leaf: int, bootstrap: bool = True
) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=n_estimators,
        maxDepth=DEEPEST_TREE if max_depth is None else max_depth,
        minInstancesPerNode=min_samples_leaf,
        featureSubsetStrategy="all",
        maxBins=TREE_BINS,
        maxMemoryInMB=TREE_MEMORY_MB,
        cacheNodeIds=True,
        bootstrap=bootstrap,
        seed=seed,
    )


def boosted_trees(
    seed: int = 0,
    n_estimators: int = 100,
    learning_rate: float = 0.1,
    max_depth: int = 7,
    min_child_weight: int = 1,
    subsample: float = 0.6,
    colsample_bytree: float = 0.8,
) -> GBTRegressor:
    """First-order boosting; columns are sampled per node."""
    return GBTRegressor(
        maxIter=n_estimators,
        stepSize=learning_rate,
        maxDepth=max_depth,
        minInstancesPerNode=min_child_weight,
        subsamplingRate=subsample,
        featureSubsetStrategy="all" if colsample_bytree >= 1.0 else str(colsample_bytree),
        maxBins=TREE_BINS,
        maxMemoryInMB=TREE_MEMORY_MB,
        seed=seed,
    )


def fit_boosted(df: DataFrame, features: list[str], target: str, seed: int = 0, **params: Any) -> VectorModel:
    return _vector_fit(boosted_trees(seed, **params), df, features, target)


def _fit_svr(df: DataFrame, features: list[str], target: str, seed: int = 0, C: float = 1.0, **params: Any) -> Any:
    return fit_kernel(df, features, target, c=C, **params)


def _fit_mlp(df: DataFrame, features: list[str], target: str, seed: int = 0, **params: Any) -> Any:
    return fit_neural(df, features, target, seed=seed, **params)


# Display names, untuned settings and search grids. Solver, selection and iteration axes share one
# optimum and are left out.
MODELS: dict[str, ModelSpec] = {
    "linear": ModelSpec("Linear Regression", fit_linear, {}),
    "ridge": ModelSpec("Ridge", fit_ridge, {"alpha": 1.0}, {"alpha": [0.01, 0.1, 1.0, 10.0, 50.0]}),
    "lasso": ModelSpec("Lasso", fit_lasso, {"alpha": 1.0}, {"alpha": [0.0005, 0.001, 0.01, 0.1, 1.0]}),
    "elasticnet": ModelSpec(
        "ElasticNet",
        fit_elasticnet,
        {"alpha": 0.1, "l1_ratio": 0.5},
        {"alpha": [0.0005, 0.001, 0.01, 0.1, 1.0], "l1_ratio": [0.2, 0.5, 0.8]},
    ),
    "rf": ModelSpec(
        "Random Forest",
        fit_forest,
        {"n_estimators": 200, "max_depth": 15, "min_samples_leaf": 1, "min_samples_split": 2},
        {
            "n_estimators": [100, 200, 300],
            "max_depth": [None, 5, 10, 15],
            "min_samples_split": [2, 5, 10],
            "min_samples_leaf": [1, 2, 4],
        },
    ),
    "xgb": ModelSpec(
        "XGBoost",
        fit_boosted,
        {
            "n_estimators": 100,
            "learning_rate": 0.1,
            "max_depth": 7,
            "min_child_weight": 1,
            "subsample": 0.6,
            "colsample_bytree": 0.8,
        },
        {
            "n_estimators": [100, 200, 300],
            "learning_rate": [0.05, 0.1, 0.2],
            "max_depth": [3, 5, 7],
            "min_child_weight": [1, 3, 5],
            "subsample": [0.6, 0.8, 1.0],
            "colsample_bytree": [0.6, 0.8, 1.0],
        },
    ),
    "svr": ModelSpec(
        "SVR",
        _fit_svr,
        {"C": 1.0, "epsilon": 0.1, "kernel": "rbf"},
        {"C": [0.5, 1.0, 5.0, 10.0], "epsilon": [0.01, 0.05, 0.1], "kernel": ["rbf", "poly", "sigmoid"]},
    ),
    "mlp": ModelSpec(
        "MLP",
        _fit_mlp,
        {
            "hidden_layer_sizes": (100,),
            "activation": "relu",
            "alpha": 1e-4,
            "learning_rate_init": 1e-3,
            "max_iter": 1000,
            "early_stopping": False,
        },
        {
            "hidden_layer_sizes": [(100,), (128, 64), (256, 128)],
            "activation": ["relu", "tanh"],
            "alpha": [1e-4, 1e-3, 1e-2],
            "learning_rate_init": [1e-3, 1e-2],
            "early_stopping": [True, False],
        },
    ),
}


def model_spec(key: str) -> ModelSpec:
    if key not in MODELS:
        raise ValueError(f"no model is called {key!r}; there are {', '.join(MODELS)}")
    return MODELS[key]


def fit_model(
    key: str, df: DataFrame, features: list[str], target: str = "ms", params: dict | None = None, seed: int = 0
) -> Any:
    """Fit a model with the given settings, or with its untuned ones when ``params`` is None."""
    spec = model_spec(key)
    return spec.fit(df, features, target, seed=seed, **(spec.defaults if params is None else params))


def predict(model: Any, df: DataFrame, name: str, target: str = "ms", keep: list[str] | None = None) -> DataFrame:
    """Predictions in long form: ``model``, ``y``, ``yhat`` and the kept columns."""
    return model.transform(df).select(
        *(keep or []), F.lit(name).alias("model"), F.col(target).alias("y"), F.col("prediction").alias("yhat")
    )
