import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.operators import splits
from lodespark.operators.quantiles import exact_quantiles

PROBS = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}


def test_quantiles_match_brute_force(spark):
    rng = np.random.default_rng(0)
    groups = {
        "hot": np.concatenate([rng.normal(0, 3, 20_000), np.zeros(500), np.full(3_000, 1.25)]),
        "wide": rng.normal(0, 1, 300) * 10.0 ** rng.integers(-30, 30, 300),
        "ties": np.repeat([-2.0, 0.0, 7.0], 5),
        "one": np.array([3.5]),
        "narrow": 1000 + rng.random(2_000) * 1e-4,
        None: np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300)


def test_weighted_and_ungrouped(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 2)], "v double, n int")
    row = exact_quantiles(df, [], "v", PROBS, "n").first()
    vs = [1, 1, 1, 2, 10, 10]
    assert row.n == 6 and [row[x] for x in PROBS] == pytest.approx([np.quantile(vs, p) for p in PROBS.values()])


def _keys(spark, n):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("formula"))


@pytest.mark.parametrize("n,k", [(103, 10), (7, 10), (100, 10)])
def test_fold_sizes(spark, n, k):
    for seed in (0, None):
        rows = splits.kfold(_keys(spark, n), k, seed=seed).groupBy("fold").count().collect()
        want = sorted([n // k + (i < n % k) for i in range(k)], reverse=True)
        assert [c for _, c in sorted((r.fold, r["count"]) for r in rows)] == [w for w in want if w]


def test_contiguous_folds_follow_the_order(spark):
    rows = splits.kfold(_keys(spark, 57), 5, seed=None).orderBy("formula").collect()
    assert [r.fold for r in rows] == sorted(r.fold for r in rows)


def test_holdout_counts_and_seed(spark):
    keys = _keys(spark, 101)
    sides = [{r.formula for r in splits.holdout_split(keys, seed=s).where("is_train").collect()} for s in (0, 0, 1)]
    assert len(sides[0]) == 80 and sides[0] == sides[1] != sides[2]


def test_repeated_folds(spark):
    rows = splits.repeated_kfold(_keys(spark, 23), 4, [0, 5]).groupBy("seed", "fold").count().collect()
    assert sorted((r.seed, r.fold, r["count"]) for r in rows) == [(s, f, 6 if f < 4 else 5) for s in (0, 5) for f in (1, 2, 3, 4)]
    with pytest.raises(ValueError):
        splits.repeated_kfold(_keys(spark, 3), 2, [])


def test_alignment(spark):
    train = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "formula string, ms double, x double, y double")
    test = spark.createDataFrame([(9.0, 8.0, 7, "b", 6.0)], "y double, x double, extra int, formula string, ms double")
    assert splits.align_features(train, test)[1].first().asDict() == {"formula": "b", "x": 8.0, "y": 9.0, "ms": 6.0}
    with pytest.raises(ValueError, match="x, y"):
        splits.align_features(train, test.drop("x", "y"))


def test_infinite_values_have_a_place(spark):
    rows = spark.createDataFrame([(float(v),) for v in ("-inf", 1, 2, 3, "inf")], "v double")
    got = exact_quantiles(rows, [], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    assert (got.lo, got.mid, got.hi) == (float("-inf"), 2.0, float("inf"))
