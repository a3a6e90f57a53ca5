"""Whole runs: build feature tables from raw sources, evaluate models, explain them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodespark.operators import attribution, cases, cleaning, composition, distributions, metrics, significance
from lodespark.operators.features import build_features
from lodespark.operators.regressors import MODELS, fit_model, model_spec, predict
from lodespark.operators.splits import align_features, feature_columns, holdout_split, union_all
from lodespark.operators.tuning import cross_validate, grid_search
from lodespark.sources.dimensions import read_elements, read_pair_matrix
from lodespark.sources.documents import load_property_rows
from lodespark.sources.tabular import EXPORT_SCHEMA, read_table, write_table

FORMULA, TARGET = "chemical formula", "saturation magnetization"


def load_dimensions(spark: SparkSession, elements_path: str, pairs_path: str) -> tuple[DataFrame, DataFrame]:
    """The element table and the symmetric pair table, from CSV, by column name."""
    return read_elements(spark, elements_path), read_pair_matrix(spark, pairs_path)


def property_features(
    spark: SparkSession,
    root: str,
    elements: DataFrame,
    pairs: DataFrame,
    raw_sink: str | None = None,
    sink: str | None = None,
) -> DataFrame:
    """Feature table from a folder of property documents; raw rows and the table can be written out.

    Raw rows go to Parquet, as CSV has no arrays.
    """
    raw = load_property_rows(spark, root)
    if raw_sink:
        write_table(raw, raw_sink, "parquet")
    table = build_features(raw.select(FORMULA, TARGET), elements, pairs, FORMULA, TARGET)
    if sink:
        write_table(table, sink)
    return table


def export_features(
    spark: SparkSession, path: str, elements: DataFrame, pairs: DataFrame, sink: str | None = None, fmt: str = "csv"
) -> DataFrame:
    """Feature table from a tabular export."""
    raw = cleaning.clean_export(read_table(spark, path, EXPORT_SCHEMA, fmt), formula=FORMULA, target=TARGET)
    table = build_features(raw, elements, pairs, FORMULA, TARGET)
    if sink:
        write_table(table, sink)
    return table


@dataclass
class HoldoutRun:
    """Fitted models with their settings, the two sides of the split and the metrics table."""

    features: list[str]
    train: DataFrame
    test: DataFrame
    models: dict[str, Any] = field(default_factory=dict)
    params: dict[str, dict | None] = field(default_factory=dict)
    metrics: DataFrame | None = None


def _fit_all(run: HoldoutRun, keys: list[str], tune: bool, formula: str, target: str, seed: int) -> HoldoutRun:
    for key in keys:
        spec = model_spec(key)
        params = grid_search(key, run.train, run.features, target, formula, seed=seed)[0] if tune and spec.grid else None
        run.models[key] = fit_model(key, run.train, run.features, target, params, seed)
        run.params[key] = params
    scored = [predict(m, run.test, MODELS[k].name, target) for k, m in run.models.items()]
    run.metrics = metrics.holdout_metrics(union_all(scored))
    return run


def holdout_run(
    table: DataFrame,
    keys: list[str],
    tune: bool = False,
    formula: str = FORMULA,
    target: str = TARGET,
    train_size: float = 0.8,
    seed: int = 0,
) -> HoldoutRun:
    """Split, tune on request, fit and score. The split is kept for the run."""
    features = feature_columns(table, target, formula)
    split = holdout_split(table, formula, train_size, seed).persist()
    run = HoldoutRun(features, split.where("is_train"), split.where("not is_train"))
    return _fit_all(run, keys, tune, formula, target, seed)


def ood_run(
    train: DataFrame,
    test: DataFrame,
    keys: list[str],
    tune: bool = False,
    formula: str = FORMULA,
    target: str = TARGET,
    seed: int = 0,
) -> HoldoutRun:
    """Fit on one table and score on a foreign one with the same features."""
    left, right, features = align_features(train, test, target, formula)
    return _fit_all(HoldoutRun(features, left.persist(), right.persist()), keys, tune, formula, target, seed)


def cross_validation_run(
    table: DataFrame,
    keys: list[str],
    k: int = 10,
    seeds: list[int] | None = None,
    tune: bool = False,
    shuffle: bool = True,
    settings: dict[str, dict] | None = None,
    formula: str = FORMULA,
    target: str = TARGET,
) -> dict[str, DataFrame]:
    """Fold metrics and summary per seed; with both tree models, also their wins and paired tests."""
    features = feature_columns(table, target, formula)
    folds = cross_validate(
        table, features, keys, k, seeds, target, formula, tune, settings=settings, shuffle=shuffle
    )
    out = {"folds": folds, "summary": metrics.cv_summary(folds, ["seed", "model"])}
    if "rf" in keys and "xgb" in keys:
        pair = MODELS["rf"].name, MODELS["xgb"].name
        diffs = significance.paired_differences(folds, *pair, metrics=["mse", "mae"], by=["seed"])
        out["wins"] = metrics.win_counts(folds, *pair, by=["seed"])
        out["paired_t"] = significance.paired_t(diffs, ["seed"])
        out["wilcoxon"] = significance.wilcoxon(diffs, ["seed"])
    return out


def distribution_report(table: DataFrame, formula: str = FORMULA, target: str = TARGET) -> dict[str, DataFrame]:
    """The tables behind the histogram, density and violin figures, and the radix summary."""
    return {
        "group_histogram": distributions.group_histogram(table, formula, target),
        "histogram": distributions.auto_histogram(table, target),
        "density": distributions.density(table, formula, target),
        "violin_quartiles": distributions.violin_quartiles(table, formula, target),
        "violin_density": distributions.violin_density(table, formula, target),
        "radix": composition.radix_summary(table, formula),
    }


def interpretation_report(
    run: HoldoutRun, elements: DataFrame, pairs: DataFrame, formula: str = FORMULA, target: str = TARGET, seed: int = 0
) -> dict[str, DataFrame]:
    """Importance and attribution of the forest; alloy series once forest, boosting and ridge are there."""
    out: dict[str, DataFrame] = {}
    if "rf" in run.models:
        forest = run.models["rf"]
        out["importance"] = attribution.permutation_importance(
            forest, run.test, run.features, target=target, key=formula, seed=seed
        )
        background = attribution.background_rows(run.train, run.features, formula, seed=seed)
        out["shapley"] = attribution.shapley_values(forest, run.test, background, run.features, formula)
    if {"rf", "xgb", "ridge"} <= set(run.models):
        shown = {"random forest": "rf", "boosted trees": "xgb", "ridge regression": "ridge"}
        out["case_studies"] = cases.comparison_table({n: run.models[k] for n, k in shown.items()}, elements, pairs)
    return out
