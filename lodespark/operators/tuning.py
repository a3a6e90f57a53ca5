"""Grid search on contiguous folds, and repeated cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from operator import add
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.operators import linear_path
from lodespark.operators.blocks import fold_sums, numeric_blocks, sum_over
from lodespark.operators.kernel_regression import fit_kernels, kernel_cv_errors
from lodespark.operators.ledger import Ledger
from lodespark.operators.metrics import METRICS, fold_metrics
from lodespark.operators.neural_regression import fit_networks, neural_cv_errors
from lodespark.operators.regressors import fit_boosted, fit_forest, fit_model, model_spec, predict
from lodespark.operators.splits import fold_of_rank, kfold, ordered_rank, repeated_kfold
from lodespark.operators.tree_tables import TreeArrays, node_table
from lodespark.session import checkpointed, inline_table, sized

LINEAR_FAMILY = ("linear", "ridge", "lasso", "elasticnet")
# Models whose fits on several training sets share their passes.
STACKED = ("svr", "mlp")
PARALLEL_FITS = 4
# Models whose fits are hundreds of short jobs that leave a core idle most of the time and hold little at the driver.
SHORT_JOBS = ("xgb",)
SEARCH_FOLDS = 5
# Keys that are ranked together when training sets are cut into inner folds.
RANGE_ROWS = 50_000
# Held-out rows that are scored by all cuts of a forest at once.
SCORED_ROWS = 64
FOLD_SCHEMA = T.StructType(
    [
        T.StructField("seed", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
    ]
)


def _parallel(spark: SparkSession, jobs: list[Callable[[], Any]], parallelism: int) -> list[Any]:
    """Run independent Spark jobs side by side on one session."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs))


def _side_by_side(spark: SparkSession, short: list[Callable[[], Any]], long: list[Callable[[], Any]], parallelism: int) -> None:
    """Run fits of short jobs, as many as there are cores, beside the others, ``parallelism`` at once."""
    groups = [(short, max(parallelism, spark.sparkContext.defaultParallelism)), (long, parallelism)]
    _parallel(spark, [partial(_parallel, spark, jobs, width) for jobs, width in groups if jobs], len(groups))


def _linear_settings(key: str, params: dict) -> dict:
    """Arguments of the moment solver for a model of the linear family."""
    if key == "linear":
        return {}
    if key == "ridge":
        return {"alpha": params["alpha"]}
    return {"alpha": params["alpha"], "l1_ratio": params.get("l1_ratio", 1.0)}


def _mse(model: Any, df: DataFrame, target: str) -> float:
    error = F.col(target) - F.col("prediction")
    return float(model.transform(df).agg(F.avg(error * error)).first()[0])


def grid_search(
    key: str,
    df: DataFrame,
    features: list[str],
    target: str = "ms",
    order_key: str = "formula",
    k: int = SEARCH_FOLDS,
    grid: dict[str, list] | None = None,
    seed: int = 0,
    parallelism: int = PARALLEL_FITS,
) -> tuple[dict, DataFrame]:
    """Best settings by mean squared error over ``k`` contiguous folds, and the score of every grid point.

    Linear models are searched from one pass of sums per fold. A forest is fitted once per smallest leaf and cut for the
    other axes. Boosting is fitted once for the longest chain and scored at every shorter length on the way. Kernels and
    networks take the steps of all fits in the same passes.
    """
    spec = model_spec(key)
    settings = spec.settings(grid)
    if not settings or not spec.grid:
        raise ValueError(f"{key} has nothing to tune")
    folds = kfold(df.select(order_key, *features, target), k, order_key, seed=None)
    if key in LINEAR_FAMILY:
        moments = linear_path.moments_by(folds, features, target, ["fold"])
        errors = linear_path.cv_errors(moments, [_linear_settings(key, s) for s in settings])
        scores = [sum(e) / len(e) for e in errors]
    else:
        folds = sized(folds).persist()
        try:
            if key == "rf":
                scores = _search_forest(folds, features, target, settings, k, seed, parallelism)
            elif key == "svr":
                errors = kernel_cv_errors(folds, features, target, settings, k)
                scores = [sum(e) / len(e) for e in errors]
            elif key == "xgb":
                scores = _search_boosted(folds, features, target, settings, k, seed, parallelism)
            else:
                errors = neural_cv_errors(folds, features, target, settings, k, seed)
                scores = [sum(e) / len(e) for e in errors]
        finally:
            folds.unpersist()
    best = settings[min(range(len(settings)), key=lambda i: scores[i])]
    return best, _score_table(df.sparkSession, settings, scores)


def _score_table(spark: SparkSession, settings: list[dict], scores: list[float]) -> DataFrame:
    names = list(settings[0])
    schema = T.StructType(
        [T.StructField("point", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in names]
        + [T.StructField("mse", T.DoubleType())]
    )
    rows = [(i, *[str(s[n]) for n in names], float(v)) for i, (s, v) in enumerate(zip(settings, scores))]
    return inline_table(spark, schema, rows)


def _search_forest(folds, features, target, settings, k, seed, parallelism) -> list[float]:
    """One fit per fold and smallest leaf scores all other points.

    A shallower tree is the head of a deeper one, a forest of fewer trees the front of a larger one, and a node that
    may not be split for its few rows is a cut. Each fit gives the squared errors of its points in one pass.
    """
    full = {**model_spec("rf").defaults, "min_samples_split": 2}
    points = [{**full, **s} for s in settings]
    leaves = sorted({p["min_samples_leaf"] for p in points})
    blocks = numeric_blocks(folds, ["fold", *features], target)

    def job(leaf: int, fold: int) -> Callable[[], dict[int, float]]:
        mine = [i for i, p in enumerate(points) if p["min_samples_leaf"] == leaf]
        sizes = sorted({points[i]["n_estimators"] for i in mine})
        depths = list(dict.fromkeys(points[i]["max_depth"] for i in mine))
        splits = sorted({points[i]["min_samples_split"] for i in mine})
        deepest = None if None in depths else max(depths)

        def run() -> dict[int, float]:
            train = folds.where(F.col("fold") != fold)
            model = fit_forest(train, features, target, seed, sizes[-1], deepest, leaf)
            trees = TreeArrays.of(node_table(model, folds.sparkSession, True))

            def squares(block: np.ndarray) -> np.ndarray:
                rows = block[block[:, 0] == fold]
                total = np.zeros((len(sizes), len(depths), len(splits)))
                for at in range(0, len(rows), SCORED_ROWS):
                    part = rows[at : at + SCORED_ROWS]
                    values = trees.cut_values(part[:, 1:-1], depths, splits)
                    for i, n in enumerate(sizes):
                        total[i] += ((values[..., :n].mean(axis=-1) - part[:, -1]) ** 2).sum(axis=-1)
                return np.append(total.ravel(), len(rows))

            *total, n = sum_over(blocks, squares, len(sizes) * len(depths) * len(splits) + 1)
            means = np.reshape(total, (len(sizes), len(depths), len(splits))) / max(n, 1.0)
            at = lambda p: (sizes.index(p["n_estimators"]), depths.index(p["max_depth"]), splits.index(p["min_samples_split"]))
            return {i: float(means[at(points[i])]) for i in mine}

        return run

    try:
        found = _parallel(folds.sparkSession, [job(leaf, f) for leaf in leaves for f in range(1, k + 1)], parallelism)
    finally:
        blocks.unpersist()
    return [sum(errors[i] for errors in found if i in errors) / k for i in range(len(points))]


def _search_boosted(folds, features, target, settings, k, seed, parallelism) -> list[float]:
    chains: dict[tuple, list[int]] = {}
    for i, s in enumerate(settings):
        chains.setdefault(tuple((n, v) for n, v in s.items() if n != "n_estimators"), []).append(i)

    def job(rest: tuple, members: list[int], fold: int) -> Callable[[], list[float]]:
        def run() -> list[float]:
            lengths = [settings[i].get("n_estimators", 100) for i in members]
            model = fit_boosted(
                folds.where(F.col("fold") != fold), features, target, seed, n_estimators=max(lengths), **dict(rest)
            )
            valid = model.pipeline.stages[0].transform(folds.where(F.col("fold") == fold))
            errors = model.stage.evaluateEachIteration(valid, "squared")
            return [float(errors[n - 1]) for n in lengths]

        return run

    plan = [(members, job(rest, members, f)) for rest, members in chains.items() for f in range(1, k + 1)]
    totals = [0.0] * len(settings)
    for (members, _), errors in zip(plan, _parallel(folds.sparkSession, [j for _, j in plan], parallelism)):
        for i, e in zip(members, errors):
            totals[i] += e / k
    return totals


def linear_cv_predictions(
    folds: DataFrame, features: list[str], target: str, keys: list[str], by_seed: bool = True
) -> DataFrame:
    """Held-out predictions of the linear family on every (seed, fold), from two passes for all fits together.

    The coefficients, one row per model and fold, go back to the rows in one broadcast join.
    """
    by = ["seed", "fold"] if by_seed else ["fold"]
    moments = linear_path.moments_by(folds, features, target, by)
    rows = []
    for group in sorted(moments):
        same_seed = [m for g, m in moments.items() if g[:-1] == group[:-1]]
        whole = same_seed[0]
        for m in same_seed[1:]:
            whole = whole + m
        for key in keys:
            spec = model_spec(key)
            fit = linear_path.solve(whole - moments[group], **_linear_settings(key, spec.defaults))
            rows.append((*[int(g) for g in group], spec.name, fit.intercept, *map(float, fit.coefficients)))
    return _scored_by(folds, rows, by, features, target)


def linear_search_predictions(
    key: str, df: DataFrame, features: list[str], target: str = "ms", order_key: str = "formula", k: int = SEARCH_FOLDS
) -> DataFrame:
    """Held-out predictions behind every score of a linear search: (fold, model, y, yhat), ``model`` the grid point."""
    folds = kfold(df.select(order_key, *features, target), k, order_key, seed=None)
    moments = linear_path.moments_by(folds, features, target, ["fold"])
    whole = reduce(add, moments.values())
    fits = []
    for (fold,), held in sorted(moments.items()):
        for point, setting in enumerate(model_spec(key).settings()):
            fit = linear_path.solve(whole - held, **_linear_settings(key, setting))
            fits.append((int(fold), str(point), fit.intercept, *map(float, fit.coefficients)))
    return _scored_by(folds, fits, ["fold"], features, target)


def inner_folds(folds: DataFrame, k: int, key: str) -> DataFrame:
    """Contiguous inner folds in key order of every training set at once: a row per (seed, fold left out) and key.

    Adds ``outer``, the fold that is left out, and ``inner`` (1..k). Only keys are copied and ranked: inside
    (seed, outer, range of keys), the ranges' counts give the offsets.
    """
    ranked = ordered_rank(folds.select(key).distinct(), [key])
    span = F.floor(F.col("_rank") / F.lit(RANGE_ROWS)).alias("_range")
    outers = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    copies = (
        folds.select(key, "seed", "fold")
        .join(ranked.select(key, span), key)
        .withColumn("outer", F.explode(F.array(*[F.lit(int(o)) for o in outers])))
        .where("outer <> fold")
    )
    group = ["seed", "outer"]
    sizes = copies.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    whole = W.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(
        *group, "_range", (F.sum("_size").over(before) - F.col("_size")).alias("_offset"), F.sum("_size").over(whole).alias("_n")
    )
    row = F.row_number().over(W.partitionBy(*group, "_range").orderBy(key))
    return (
        copies.withColumn("_row", row)
        .join(offsets, [*group, "_range"])
        .select(key, *group, fold_of_rank(F.col("_offset") + F.col("_row") - 1, F.col("_n"), k).alias("inner"))
    )


def tuned_linear_cv(
    folds: DataFrame, features: list[str], target: str, keys: list[str], key: str, grids: dict[str, dict] | None = None
) -> DataFrame:
    """Held-out predictions of tuned linear models on every (seed, fold), as :func:`linear_cv_predictions` gives them.

    Inner folds are ranked once and shared by all models; one pass of sums over them gives every search and fit.
    """
    inner = inner_folds(folds, SEARCH_FOLDS, key)
    rows = inner.join(folds.drop("fold"), [key, "seed"])
    moments = linear_path.moments_by(rows, features, target, ["seed", "outer", "inner"])
    fits = []
    for seed, outer in sorted({g[:2] for g in moments}):
        mine = {g: m for g, m in moments.items() if g[:2] == (seed, outer)}
        whole = reduce(add, mine.values())
        for name in keys:
            spec = model_spec(name)
            settings = spec.settings((grids or {}).get(name))
            errors = linear_path.cv_errors(mine, [_linear_settings(name, s) for s in settings])
            best = settings[min(range(len(settings)), key=lambda i: sum(errors[i]))]
            fit = linear_path.solve(whole, **_linear_settings(name, best))
            fits.append((int(seed), int(outer), spec.name, fit.intercept, *map(float, fit.coefficients)))
    return _scored_by(folds, fits, ["seed", "fold"], features, target)


def _scored_by(folds: DataFrame, fits: list[tuple], by: list[str], features: list[str], target: str) -> DataFrame:
    """Rows scored with the coefficients of their group: one broadcast row per model and fold."""
    schema = T.StructType(
        [T.StructField(b, T.IntegerType()) for b in by]
        + [T.StructField("model", T.StringType())]
        + [T.StructField(n, T.DoubleType()) for n in ["_b", *[f"_w{i}" for i in range(len(features))]]]
    )
    table = F.broadcast(inline_table(folds.sparkSession, schema, fits))
    yhat = F.col("_b")
    for i, f in enumerate(features):
        yhat = yhat + F.col(f"_w{i}") * F.col(f)
    return folds.join(table, by).select(*by, "model", F.col(target).alias("y"), yhat.alias("yhat"))


def cross_validate(
    df: DataFrame,
    features: list[str],
    keys: list[str],
    k: int = 10,
    seeds: list[int] | None = None,
    target: str = "ms",
    key: str = "formula",
    tune: bool = False,
    grids: dict[str, dict] | None = None,
    settings: dict[str, dict] | None = None,
    shuffle: bool = True,
    parallelism: int = PARALLEL_FITS,
    ledger: str | None = None,
) -> DataFrame:
    """The four metrics of every model on every held-out fold of every seed: (seed, model, fold, ...).

    ``settings`` replaces a model's untuned settings; with ``tune`` they are searched inside each training set.
    Linear models share one pass, tuned or not; kernels and networks take the folds of a seed in the same passes. Rows
    are appended to ``ledger``, a folder, as they are finished; a run that finds some there leaves their work out.
    Boosted fits wait for their many short jobs, so all of them run beside the others, ``parallelism`` of which run at once.
    """
    specs = {m: model_spec(m) for m in keys}
    seeds = [0] if seeds is None else seeds
    given = settings or {}
    spark = df.sparkSession
    finished = Ledger(spark, FOLD_SCHEMA, ledger)
    planned = [(s, specs[m].name, f) for m in keys for s in seeds for f in range(1, k + 1)]
    open_: dict[tuple[str, int], list[int]] = {}
    by_name = {specs[m].name: m for m in keys}
    for s, name, f in finished.left(planned, ["seed", "model", "fold"]):
        open_.setdefault((by_name[name], s), []).append(f)
    base = df.select(key, *features, target)
    if shuffle:
        folds = repeated_kfold(base, k, seeds, key)
    else:
        folds = kfold(base, k, key, None).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    # Every job of a fit ships its lineage, so that of the rows ends here, in the order that the cache has them.
    cached = folds.persist()
    folds = checkpointed(cached).persist()
    searched = [m for m in keys if tune and specs[m].grid]

    def single(m: str, seed: int, fold: int) -> Callable[[], None]:
        def run() -> None:
            mine = folds.where(F.col("seed") == seed)
            train, valid = mine.where(F.col("fold") != fold), mine.where(F.col("fold") == fold)
            params = given.get(m)
            if m in searched:
                params, _ = grid_search(m, train, features, target, key, grid=(grids or {}).get(m), seed=seed)
            model = fit_model(m, train, features, target, params, seed)
            row = fold_metrics(predict(model, valid, specs[m].name, target), ["model"]).first()
            finished.add([] if row is None else [(seed, row.model, fold, *[float(row[x]) for x in METRICS])])

        return run

    def stacked(m: str, seed: int, outs: list[int]) -> Callable[[], None]:
        def run() -> None:
            rows = sized(folds.where(F.col("seed") == seed).withColumn("_fold", F.col("fold")))
            point = [given.get(m, specs[m].defaults)]
            fit = fit_kernels if m == "svr" else partial(fit_networks, seed=seed)
            models = dict(zip(outs, (found[0] for found in fit(rows, features, target, point, outs))))
            found = fold_sums(rows, features, target, models)
            finished.add([(seed, specs[m].name, f, *[found[f][x] for x in METRICS]) for f in outs if f in found])

        return run

    short, long = [], []
    for (m, seed), outs in open_.items():
        if m in LINEAR_FAMILY and (m in searched or m not in given):
            continue
        if m in STACKED and m not in searched:
            long.insert(0, stacked(m, seed, outs))
        else:
            (short if m in SHORT_JOBS and m not in searched else long).extend(single(m, seed, f) for f in outs)
    try:
        shared = [m for m in keys if m in LINEAR_FAMILY and m not in given and m not in searched and any(o[0] == m for o in open_)]
        tuned = [m for m in keys if m in LINEAR_FAMILY and m in searched and any(o[0] == m for o in open_)]
        linear = [linear_cv_predictions(folds, features, target, shared)] if shared else []
        linear += [tuned_linear_cv(folds, features, target, tuned, key, grids)] if tuned else []
        for scored in (fold_metrics(p, ["seed", "model", "fold"]) for p in linear):
            rows = [(r.seed, r.model, r.fold, *[float(r[x]) for x in METRICS]) for r in scored.collect()]
            finished.add([r for r in rows if r[2] in open_.get((by_name[r[1]], r[0]), [])])
        _side_by_side(spark, short, long, parallelism)
    finally:
        folds.unpersist()
        cached.unpersist()
    # One row per seed, fold and model.
    wanted = inline_table(spark, T.StructType(FOLD_SCHEMA.fields[:3]), planned)
    return finished.table().join(F.broadcast(wanted), ["seed", "model", "fold"], "left_semi").select(*FOLD_SCHEMA.names)
