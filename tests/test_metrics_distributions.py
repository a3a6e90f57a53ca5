import numpy as np
import pytest

from lodespark.functions import pvalues
from lodespark.operators import distributions, metrics, significance


def test_t_table():
    # Two-sided 5 % points of published t tables.
    for df, t in ((1, 12.706), (4, 2.776), (9, 2.262), (30, 2.042), (1000, 1.962)):
        assert pvalues.student_t_two_sided(t, df) == pytest.approx(0.05, abs=2e-4)
    assert pvalues.student_t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert pvalues.student_t_two_sided(float("inf"), 5) == pytest.approx(0.0)


def test_wilcoxon_table():
    # Critical values of published signed-rank tables.
    assert pvalues.signed_rank_exact(8, 10) == pytest.approx(0.048828, abs=1e-6)
    assert pvalues.signed_rank_exact(0, 5) == pytest.approx(0.0625)
    assert pvalues.signed_rank_exact(52, 20) == pytest.approx(0.048441, abs=1e-5)
    assert pvalues.signed_rank_normal(27.5, 10, 0.0) == pytest.approx(1.0)


def _folds(spark, a, b):
    rows = [(m, i, float(v)) for m, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "model string, fold int, mse double")


def test_paired_tests(spark):
    a, b = [1, 2, 3, 4, 5, 6], [2, 2, 1, 3, 9, 5.5]
    folds = _folds(spark, a, b)
    diffs = significance.paired_differences(folds, "a", "b", ["mse"])
    d = np.array(a) - np.array(b)
    t = significance.paired_t(diffs).first()
    assert t.n == 6 and t.t == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(6)))
    w = significance.wilcoxon(diffs).first()
    # Sizes 0.5, 1, 1, 2, 4 rank 1, 2.5, 2.5, 4, 5; the zero is dropped; ties call for the normal form.
    assert (w.n, w.w) == (5, 7.5)
    assert w.p == pytest.approx(pvalues.signed_rank_normal(7.5, 5, 2**3 - 2))
    wins = metrics.win_counts(folds, "a", "b").first()
    assert (wins.wins_a, wins.wins_b, wins.ties) == (2, 3, 1)


def test_identical_models(spark):
    diffs = significance.paired_differences(_folds(spark, [1, 2], [1, 2]), "a", "b", ["mse"])
    row = significance.wilcoxon(diffs).first()
    assert row.n == 0 and row.w is None
    assert metrics.win_counts(_folds(spark, [1, 2], [1]), "a", "b").count() == 0


def _values(spark):
    rng = np.random.default_rng(3)
    edges = [i * 0.2 for i in range(14)]
    ms = np.concatenate([rng.gamma(3, 0.35, 3000), edges, np.nextafter(edges, 0), [2.4, 2.4, 5.0]])
    names = rng.choice(["Fe3B", "FeCo", "MnCr2", "Ni"], len(ms))
    df = spark.createDataFrame([*zip(names.tolist(), ms.tolist()), ("Fe", None)], "formula string, ms double")
    return df, names, ms


def test_histograms_match_numpy(spark):
    df, names, ms = _values(spark)
    rows = distributions.group_histogram(df).collect()
    for g in distributions.GROUPS:
        mine = ms[[g in n for n in names]]
        want = np.histogram(mine[mine >= 0], bins=np.arange(0.0, 2.6, 0.2))[0]
        assert [r.n for r in sorted(rows, key=lambda r: r.bin) if r.grp == g] == want.tolist()
    want, edges = np.histogram(ms, bins="auto")
    got = sorted(distributions.auto_histogram(df).collect(), key=lambda r: r.bin)
    assert [r.n for r in got] == want.tolist()
    assert [r.lo for r in got] == pytest.approx(edges[:-1]) and got[-1].hi == pytest.approx(edges[-1])


def test_constant_values_make_one_bin(spark):
    df = spark.createDataFrame([("Fe", 1.0)] * 5, "formula string, ms double")
    row = distributions.auto_histogram(df).collect()
    assert [(r.lo, r.hi, r.n) for r in row] == [(0.5, 1.5, 5)]
    assert distributions.density(df).count() == 0


def test_density_matches_brute_force(spark):
    df, names, ms = _values(spark)
    rows = sorted((r for r in distributions.violin_density(df).collect() if r.grp == "Co"), key=lambda r: r.i)
    mine = ms[[("Co" in n) for n in names]]
    bw = mine.std(ddof=1) * len(mine) ** -0.2
    x = np.linspace(mine.min() - 2 * bw, mine.max() + 2 * bw, 100)
    want = np.exp(-0.5 * ((x[:, None] - mine) / bw) ** 2).sum(1) / (len(mine) * bw * np.sqrt(2 * np.pi))
    assert [r.x for r in rows] == pytest.approx(x) and [r.density for r in rows] == pytest.approx(want)


def test_violin_rows_overlap(spark):
    df, names, _ = _values(spark)
    quart = {r.grp: r.n for r in distributions.violin_quartiles(df).collect()}
    assert quart["all"] == len(names) and quart["Co"] == sum("Co" in n for n in names)
    assert distributions.long_groups(df).where("grp = 'Fe' and value is not null").count() == quart["Fe"]


def test_unpaired_models_raise(spark):
    from lodespark.operators.significance import paired_differences

    folds = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.5)], "model string, fold int, mse double")
    with pytest.raises(ValueError, match="number of folds"):
        paired_differences(folds, "a", "b", ["mse"])
    with pytest.raises(ValueError, match="model c"):
        paired_differences(folds, "a", "c", ["mse"])


def test_audit_counts_null_compositions_as_the_cleaning_does(spark):
    from lodespark.operators.cleaning import clean_export, cleaning_audit

    rows = spark.createDataFrame(
        [(None, "1", True), ("Fe", "1", True)], "composition string, total_magnetization_normalized_vol string, is_magnetic boolean"
    )
    assert [r.n_rows for r in cleaning_audit(rows).orderBy("step_no").collect()] == [2, 2, 1, 1]
    assert clean_export(rows).count() == 1


@pytest.mark.parametrize("cut", [0.0, 2.0])
def test_density_leaves_out_only_what_is_out_of_reach(spark, cut):
    """Clusters far apart: whole grid, next to the full sum; points between them are met by no value but the first."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 0.01, 3000), rng.normal(1, 0.01, 20), [40.0, 40.0, 41.0]])
    frame = spark.createDataFrame([("Fe2O3", float(v)) for v in values], "formula string, ms double")
    got = distributions.density(frame, grid=60, cut=cut).where("grp = 'Fe'").orderBy("i").collect()
    bw = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min() - cut * bw, values.max() + cut * bw, 60)
    peak = 1 / (bw * np.sqrt(2 * np.pi))
    want = np.exp(-0.5 * ((x[:, None] - values) / bw) ** 2).mean(axis=1) * peak
    assert [r["i"] for r in got] == list(range(60))
    assert np.allclose([r["x"] for r in got], x, rtol=0, atol=1e-9)
    assert np.abs(np.array([r["density"] for r in got]) - want).max() <= 1e-12 * peak
    within = (np.abs(x[:, None] - values) <= distributions.REACH * bw).sum()
    assert within < 0.5 * 60 * len(values)
