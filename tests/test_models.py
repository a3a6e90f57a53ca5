import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lodespark.operators import attribution, linear_path, neural_regression, regressors, tree_tables, tuning
from lodespark.operators.regressors import MODELS, fit_model, model_spec

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(1500, 200, 240), rng.normal(0, 1, 240), rng.integers(0, 3, 240)])
    y = 0.002 * x[:, 0] - 0.7 * x[:, 1] + 0.3 * x[:, 2] ** 2 + rng.normal(0, 0.05, 240)
    pdf = pd.DataFrame(x, columns=XS).assign(ms=y, formula=[f"f{i:03d}" for i in range(240)])
    return spark.createDataFrame(pdf).persist(), pdf


def _centred(pdf):
    x, y = pdf[XS].to_numpy(float), pdf.ms.to_numpy()
    return x - x.mean(0), y - y.mean()


def test_ridge_closed_form(data):
    df, pdf = data
    x, y = _centred(pdf)
    for key, alpha in (("linear", 0.0), ("ridge", 3.0)):
        fit = fit_model(key, df, XS, params={"alpha": alpha} if alpha else {}).fit
        assert fit.coefficients == pytest.approx(np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y), rel=1e-9)
        assert fit.intercept == pytest.approx(pdf.ms.mean() - pdf[XS].mean().to_numpy() @ fit.coefficients)


@pytest.mark.parametrize("alpha,l1", [(0.05, 1.0), (0.1, 0.5)])
def test_elastic_net_optimality(data, alpha, l1):
    df, pdf = data
    x, y = _centred(pdf)
    w = linear_path.fit_from_moments(df, XS, "ms", alpha, l1).fit.coefficients
    slack = x.T @ (y - x @ w) / len(y) - alpha * (1 - l1) * w
    for s, v in zip(slack, w):
        assert s == pytest.approx(alpha * l1 * np.sign(v), abs=1e-6) if v else abs(s) <= alpha * l1 + 1e-9


def test_agrees_with_spark_ml(data):
    df, pdf = data
    rows = VectorAssembler(inputCols=XS, outputCol="x").transform(df)
    s_y, n = pdf.ms.std(), len(pdf)
    ml = LinearRegression(
        featuresCol="x", labelCol="ms", standardization=False, regParam=2.0 * s_y / n, solver="l-bfgs", tol=1e-12, maxIter=1000
    ).fit(rows)
    assert fit_model("ridge", df, XS, params={"alpha": 2.0}).fit.coefficients == pytest.approx(ml.coefficients.toArray(), rel=1e-5)


def test_linear_search_matches_refits(data):
    df, pdf = data
    best, scores = tuning.grid_search("ridge", df, XS, grid={"alpha": [0.01, 50.0, 5000.0]})
    got = [r.mse for r in scores.orderBy("point").collect()]
    folds = np.array_split(np.arange(240), 5)
    for alpha, mse in zip([0.01, 50.0, 5000.0], got):
        errors = []
        for f in folds:
            tr = pdf.drop(index=f)
            x, y = _centred(tr)
            w = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y)
            va = pdf.loc[f]
            errors.append(((va.ms - tr.ms.mean() - (va[XS] - tr[XS].mean()) @ w) ** 2).mean())
        assert mse == pytest.approx(np.mean(errors), rel=1e-8)
    assert best == {"alpha": [0.01, 50.0, 5000.0][int(np.argmin(got))]}


def test_unknown_models(data):
    with pytest.raises(ValueError, match="no model is called"):
        model_spec("nope")
    with pytest.raises(ValueError):
        tuning.grid_search("linear", data[0], XS)


def test_grids_hold_every_distinct_point():
    assert {k: len(m.settings()) for k, m in MODELS.items() if m.grid} == {
        "ridge": 5, "lasso": 5, "elasticnet": 15, "rf": 108, "xgb": 729, "svr": 36, "mlp": 72,
    }


FAST = {
    "rf": {"n_estimators": 10, "max_depth": 6},
    "xgb": {"n_estimators": 20, "max_depth": 3, "subsample": 1.0},
    "svr": {"C": 10.0, "epsilon": 0.05, "kernel": "rbf"},
    "mlp": {"hidden_layer_sizes": (32,), "learning_rate_init": 1e-2, "max_iter": 300},
}


@pytest.mark.parametrize("key", FAST)
def test_models_beat_the_mean(data, key):
    df, pdf = data
    # The kernel width follows the overall spread, so features of one scale are what it needs.
    df = df.withColumn("a", (F.col("a") - 1500) / 200)
    model = fit_model(key, df, XS, params=FAST[key])
    assert tuning._mse(model, df, "ms") < 0.6 * pdf.ms.var()


@pytest.mark.parametrize("kernel", ["poly", "sigmoid"])
def test_other_kernels_run(data, kernel):
    df = data[0].withColumn("a", (F.col("a") - 1500) / 200)
    model = fit_model("svr", df, XS, params={"C": 1.0, "epsilon": 0.1, "kernel": kernel})
    assert np.isfinite(tuning._mse(model, df, "ms"))


def test_early_stopping_runs(data):
    model = fit_model("mlp", data[0], XS, params={**FAST["mlp"], "early_stopping": True, "activation": "tanh"})
    assert tuning._mse(model, data[0], "ms") < data[1].ms.var()


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_neural_gradient(activation):
    rng = np.random.default_rng(0)
    shapes = neural_regression.layer_shapes(3, (5, 4))
    theta = neural_regression.initial_weights(shapes, activation, 0)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    loss = lambda t: neural_regression.loss_gradient(t, x, y, shapes, activation, 0.1)[0]
    grad = neural_regression.loss_gradient(theta, x, y, shapes, activation, 0.1)[1]
    step = 1e-6
    for i in range(0, len(theta), 5):
        e = np.zeros(len(theta))
        e[i] = step
        assert grad[i] == pytest.approx((loss(theta + e) - loss(theta - e)) / (2 * step), abs=1e-6)


def test_boosted_search_reuses_chains(data):
    df, _ = data
    grid = {"n_estimators": [2, 4], "max_depth": [2]}
    best, scores = tuning.grid_search("xgb", df, XS, grid=grid, k=2)
    rows = {r.n_estimators: r.mse for r in scores.collect()}
    assert rows["4"] < rows["2"] and best["n_estimators"] == 4


def test_cross_validation_shapes(data):
    folds = tuning.cross_validate(df := data[0], XS, ["linear", "ridge", "rf"], 3, [0, 7], settings={"rf": FAST["rf"]})
    rows = folds.collect()
    assert len(rows) == 18 and {r.model for r in rows} == {"Linear Regression", "Ridge", "Random Forest"}
    assert all(r.r2 > 0.5 for r in rows if r.model == "Linear Regression")
    plain = tuning.cross_validate(df, XS, ["linear"], 4, shuffle=False).collect()
    assert sorted(r.fold for r in plain) == [1, 2, 3, 4]


def test_boosted_fits_run_beside_all_others(data, monkeypatch):
    """The boosted fits of all folds run at once, beside as many others as are asked for."""
    together = threading.Barrier(6)

    def fit(key, df, features, target, params, seed):
        if key == "xgb":
            together.wait(timeout=60)
        return fit_model("linear", df, features, target)

    monkeypatch.setattr(tuning, "fit_model", fit)
    rows = tuning.cross_validate(data[0], XS, ["rf", "xgb"], 6, parallelism=2).collect()
    assert sorted((r.model, r.fold) for r in rows) == [(m, f) for m in ("Random Forest", "XGBoost") for f in range(1, 7)]


def test_forest_cuts_are_fits(data, spark):
    """A tree cut at a depth is the tree grown to it; a node of few rows ends the path; fewer trees are the first ones."""
    df, pdf = data
    deep = regressors.fit_forest(df, XS, "ms", n_estimators=6, max_depth=None, min_samples_leaf=2)
    nodes = tree_tables.node_table(deep, spark, True).persist()
    trees = tree_tables.TreeArrays.of(nodes)
    x = pdf[XS].to_numpy(float)
    values = trees.cut_values(x, [None, 1, 4], [2, 9])
    for i, depth in ((1, 1), (2, 4)):
        short = regressors.fit_forest(df, XS, "ms", n_estimators=6, max_depth=depth, min_samples_leaf=2)
        got = {r.formula: r.prediction for r in short.transform(df).collect()}
        assert [got[f] for f in pdf.formula] == pytest.approx(values[i, 0].mean(axis=1), abs=1e-12)
    table = {(r.tree, r.node): r for r in nodes.collect()}
    for row in range(0, 240, 17):
        for t in range(6):
            at, depth = table[t, 0], 0
            while at.feature is not None and at.rows >= 9 and depth < 4:
                at, depth = table[t, at.left if x[row, at.feature] <= at.threshold else at.right], depth + 1
            assert values[2, 1, row, t] == at.value
    cut = regressors.fit_forest(df, XS, "ms", n_estimators=6, max_depth=None, min_samples_leaf=2, min_samples_split=9)
    got = {r.formula: r.prediction for r in cut.transform(df).collect()}
    assert [got[f] for f in pdf.formula] == pytest.approx(values[0, 1].mean(axis=1), abs=1e-12)
    joined = tree_tables.score_by_joins(nodes, df, XS, ["formula"])
    by_join = {r.formula: r.prediction for r in joined.collect()}
    assert [by_join[f] for f in pdf.formula] == pytest.approx(values[0, 0].mean(axis=1), abs=1e-12)


def test_forest_search_scores_every_point(data):
    """Depths and nodes exactly as separate fits of as many trees; forest sizes within sampling error."""
    df, _ = data
    grid = {"n_estimators": [4, 12], "max_depth": [None, 3], "min_samples_split": [2, 8], "min_samples_leaf": [1, 4]}
    _, scores = tuning.grid_search("rf", df, XS, k=2, grid=grid)
    got = {(r.n_estimators, r.max_depth, r.min_samples_split, r.min_samples_leaf): r.mse for r in scores.collect()}
    assert len(got) == 16
    folds = tuning.kfold(df.select("formula", *XS, "ms"), 2, "formula", seed=None).persist()

    def alone(**setting):
        fits = [(fit_model("rf", folds.where(F.col("fold") != f), XS, params=setting), folds.where(F.col("fold") == f)) for f in (1, 2)]
        return np.mean([tuning._mse(m, v, "ms") for m, v in fits])

    assert got["12", "3", "8", "4"] == pytest.approx(alone(n_estimators=12, max_depth=3, min_samples_split=8, min_samples_leaf=4))
    assert got["12", "None", "2", "1"] == pytest.approx(alone(n_estimators=12, max_depth=None, min_samples_split=2, min_samples_leaf=1))
    fewer = alone(n_estimators=4, max_depth=3, min_samples_split=2, min_samples_leaf=4)
    assert got["4", "3", "2", "4"] == pytest.approx(fewer, rel=0.5)


def test_split_checks_find_a_wrong_tree(data, spark):
    df, _ = data
    model = regressors.fit_forest(df, XS, "ms", n_estimators=1, max_depth=4, bootstrap=False)
    nodes = tree_tables.node_table(model, spark, True).persist()
    good = tree_tables.split_checks(nodes, df, XS, "ms", "formula").first()
    assert (good.best_split, good.means, good.sizes) == (True, True, True)
    worse = nodes.withColumn("feature", F.when(F.col("node") == 0, (F.col("feature") + 1) % 3).otherwise(F.col("feature")))
    worse = worse.withColumn("threshold", F.when(F.col("node") == 0, 0.01).otherwise(F.col("threshold"))).persist()
    bad = tree_tables.split_checks(worse, df, XS, "ms", "formula").first()
    assert not bad.best_split and not bad.means and not bad.sizes


def test_a_stopped_evaluation_goes_on(data, spark, tmp_path, monkeypatch):
    """Finished rows are read from the ledger; only what is left is fitted; the result is that of one run."""
    df, _ = data
    fast = {"rf": {"n_estimators": 3, "max_depth": 3}, "mlp": {"hidden_layer_sizes": (4,), "max_iter": 3}}
    asked = dict(k=3, seeds=[0, 7], settings=fast, ledger=str(tmp_path / "ledger"))
    keys, fits = ["linear", "rf", "mlp"], []
    real = tuning.fit_model

    def stops(key, *args, **kwargs):
        fits.append(key)
        if len(fits) == 4:
            raise RuntimeError("stopped")
        return real(key, *args, **kwargs)

    monkeypatch.setattr(tuning, "fit_model", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        tuning.cross_validate(df, XS, keys, **asked, parallelism=1)
    done = spark.read.parquet(asked["ledger"]).filter("model = 'Random Forest'").count()
    fits[:] = [None] * 10
    whole = tuning.cross_validate(df, XS, keys, **asked).collect()
    assert len(whole) == 18 and 3 <= done < 6 and len(fits) - 10 == 6 - done
    del asked["ledger"]
    row = lambda r: (r.seed, r.model, r.fold, round(r.mse, 9), round(r.mre, 9), round(r.r2, 9))
    assert sorted(map(row, whole)) == sorted(map(row, tuning.cross_validate(df, XS, keys, **asked).collect()))


def test_permutation_importance(data):
    df, _ = data
    flat = df.withColumn("c", F.lit(1.0))
    model = fit_model("linear", flat, ["a", "b"])
    rows = attribution.permutation_importance(model, flat, XS, repeats=3).collect()
    assert rows[0].feature == "c" and rows[0].importance_mean == pytest.approx(0.0, abs=1e-12)
    assert min(r.importance_mean for r in rows[1:]) > 0.1
    assert [r.importance_mean for r in rows] == sorted(r.importance_mean for r in rows)


def test_shapley_of_a_linear_model(data):
    df, pdf = data
    model = fit_model("linear", df, XS)
    background = attribution.background_rows(df, XS, size=20)
    mean = np.mean(background, axis=0)
    for r in attribution.shapley_values(model, df.limit(5), background, XS).collect():
        x = pdf.set_index("formula").loc[r.formula, XS].to_numpy(float)
        phi = [r[f"phi_{f}"] for f in XS]
        assert phi == pytest.approx(model.fit.coefficients * (x - mean), abs=1e-9)
        assert sum(phi) == pytest.approx(r.prediction - r.base_value, abs=1e-9)


def test_shapley_adds_up_for_trees(data):
    df, _ = data
    model = fit_model("rf", df, XS, params={"n_estimators": 5, "max_depth": 4})
    values = attribution.shapley_values(model, df.limit(4), attribution.background_rows(df, XS, size=10), XS)
    for r in values.collect():
        assert sum(r[f"phi_{f}"] for f in XS) == pytest.approx(r.prediction - r.base_value, abs=1e-9)
    assert attribution.shapley_summary(values, XS).count() == 3
    with pytest.raises(ValueError):
        attribution.shapley_values(model, df, [[0.0] * 13], [f"x{i}" for i in range(13)])


@pytest.mark.parametrize("chain_rows,early", [(50_000, False), (50_000, True), (60, False), (60, True)])
def test_network_does_not_depend_on_the_layout(data, monkeypatch, chain_rows, early):
    """One chain, and several that are averaged."""
    monkeypatch.setattr(neural_regression, "CHAIN_ROWS", chain_rows)
    setting = {"hidden_layer_sizes": (16,), "learning_rate_init": 1e-2, "max_iter": 12, "early_stopping": early}
    fits = [neural_regression.fit_neural(data[0].repartition(n), XS, "ms", **setting) for n in (1, 4, 16)]
    for other in fits[1:]:
        assert np.abs(other.theta - fits[0].theta).max() < 1e-6
    assert tuning._mse(fits[0], data[0], "ms") < 0.9 * data[1].ms.var()


def test_network_steps_are_plain_adam_on_batches(data, monkeypatch):
    """Two epochs in batches of 50, hash-ordered rows shuffled by seed and epoch, by a plain loop."""
    monkeypatch.setattr(neural_regression, "BATCH", 50)
    df, _ = data
    model = neural_regression.fit_neural(df, XS, "ms", hidden_layer_sizes=(4,), alpha=0.1, max_iter=2, seed=3)
    cells = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*XS, "ms"])]
    names = [f"c{i}" for i in range(4)]
    ordered = df.select(*cells).withColumn("copy", F.lit(1).cast("long")).withColumn("at", F.xxhash64(*names, "copy"))
    rows = np.array([r[:4] for r in ordered.orderBy("at").select(*names).collect()])
    x, y = (rows[:, :3] - rows[:, :3].mean(0)) / rows[:, :3].std(0), rows[:, 3]
    shapes = neural_regression.layer_shapes(3, (4,))
    theta = neural_regression.initial_weights(shapes, "relu", 3)
    theta[-1] = y.mean()
    m, v, t = 0.0, 0.0, 0
    for epoch in range(2):
        order = np.random.default_rng([3, 0, epoch]).permutation(len(y))
        for at in range(0, len(y), 50):
            mine = order[at : at + 50]
            g = neural_regression.loss_gradient(theta, x[mine], y[mine], shapes, "relu", 0.1)[1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
    assert model.theta == pytest.approx(theta, abs=1e-9)


def test_networks_trained_together_are_those_trained_alone(data, monkeypatch):
    monkeypatch.setattr(neural_regression, "ONE_CHAIN_WEIGHTS", 200)
    rows = data[0].withColumn("_fold", F.pmod(F.xxhash64("formula"), F.lit(3)).cast("int")).persist()
    points = [{"hidden_layer_sizes": h, "activation": a, "max_iter": 8} for h in ((16,), (8, 4)) for a in ("relu", "tanh")]
    together = neural_regression.fit_networks(rows, XS, "ms", points, [0, 1, 2])
    for fold in (0, 2):
        for point in (0, 3):
            alone = neural_regression.fit_neural(rows.where(F.col("_fold") != fold).drop("_fold"), XS, "ms", **points[point])
            assert together[fold][point].hidden == alone.hidden
            both = [tuning._mse(m, rows, "ms") for m in (together[fold][point], alone)]
            assert both[0] == pytest.approx(both[1], rel=1e-3)


def test_linear_shapley_is_the_exact_game(data):
    """Against all training rows, the closed form equals the enumeration of coalitions."""
    rows = data[0].withColumn("formula", F.monotonically_increasing_id().cast("string")).limit(30).persist()
    model = fit_model("linear", rows, XS)
    closed = {r.formula: r for r in attribution.linear_shapley_values(model, rows, rows, XS).collect()}
    everything = [[float(v) for v in r] for r in rows.select(*XS).collect()]
    for r in attribution.shapley_values(model, rows, everything, XS).collect():
        assert r.base_value == pytest.approx(closed[r.formula].base_value)
        for x in XS:
            assert r[f"phi_{x}"] == pytest.approx(closed[r.formula][f"phi_{x}"], abs=1e-9)


def test_tuned_linear_models_agree_with_one_search_each(data):
    """Inner folds ranked once give what a grid search inside every training set gives."""
    rows = data[0].select("formula", *XS, "ms")
    got = tuning.cross_validate(rows, XS, ["ridge", "lasso"], 3, [0, 5], tune=True)
    folds = tuning.repeated_kfold(rows, 3, [0, 5]).persist()
    for r in got.collect():
        key = {"Ridge": "ridge", "Lasso": "lasso"}[r.model]
        mine = folds.where((F.col("seed") == r.seed))
        train, valid = mine.where(F.col("fold") != r.fold), mine.where(F.col("fold") == r.fold)
        best, _ = tuning.grid_search(key, train, XS)
        model = fit_model(key, train, XS, params=best)
        error = model.transform(valid).agg(F.avg((F.col("ms") - F.col("prediction")) ** 2)).first()[0]
        assert r.mse == pytest.approx(error)


def test_kernel_fits_in_common_passes_are_the_single_fits(data):
    grid = {"C": [1.0, 10.0], "epsilon": [0.05], "kernel": ["rbf", "sigmoid"]}
    rows = data[0].select("formula", *XS, "ms")
    _, scores = tuning.grid_search("svr", rows, XS, k=3, grid=grid)
    folds = tuning.kfold(rows, 3, "formula", None).persist()
    for r in scores.collect():
        errors = []
        for f in (1, 2, 3):
            model = fit_model("svr", folds.where(F.col("fold") != f), XS, params={"C": float(r.C), "epsilon": 0.05, "kernel": r.kernel})
            error = (F.col("ms") - F.col("prediction")) ** 2
            errors.append(model.transform(folds.where(F.col("fold") == f)).agg(F.avg(error)).first()[0])
        assert r.mse == pytest.approx(np.mean(errors), rel=1e-3)
