import math

import pytest
from pyspark.sql import functions as F

from lodespark.functions import formula as fx
from lodespark.operators import composition
from lodespark.operators.cleaning import exclude_elements
from lodespark.operators.features import build_features, featurise
from lodespark.sources import dimensions

CASES = {
    "Fe12Sn3Sb1": {"Fe": 12, "Sn": 3, "Sb": 1},
    "SmFe11Mo": {"Sm": 1, "Fe": 11, "Mo": 1},
    "Fe100Co0": {"Fe": 100},
    "Fe0.5Co0.5": {"Fe": 0.5, "Co": 0.5},
    "Fe(CoNi)2": {"Fe": 1, "Co": 2, "Ni": 2},
    "Fe2O3Fe": {"Fe": 3, "O": 3},
    "Fe2 O3": {"Fe": 2, "O": 3},
    "Fe3[Al2(Si.5C)4]2Fe": {"Fe": 4, "Al": 4, "Si": 4, "C": 8},
    "Fe((Co)": None,
    "Fe2)": None,
    "Fe)2(": None,
    "Fe(Co)2x": None,
    "xx": None,
    "Fe1.2.3": None,
    None: None,
}


def _frame(spark, formulas):
    return spark.createDataFrame([(f,) for f in formulas], "formula string")


def test_parse(spark):
    rows = fx.with_parts(_frame(spark, CASES)).select("formula", F.expr(fx.parts_map("parts")).alias("m")).collect()
    assert {r.formula: r.m for r in rows} == CASES


def test_unit_features(spark, dims):
    rows = {r.formula: r for r in featurise(_frame(spark, CASES), *dims).collect()}
    assert rows["Fe12Sn3Sb1"].stoicentw == pytest.approx(0.702919, abs=1e-6)
    pure = rows["Fe100Co0"]
    assert (pure.compoundradix, pure.stoicentw, pure.miedemaH) == (1, 0, 0)
    # Truncation empties the half amounts: sums are 0 and the group, which divides, is missing.
    halves = rows["Fe0.5Co0.5"]
    assert (halves.compoundradix, halves.Zw, halves.groupw) == (2, 0, None)
    assert all(v is None for v in rows[None].asDict().values())
    # The lanthanide has no group, so only iron and molybdenum count.
    assert rows["SmFe11Mo"].groupw == pytest.approx((11 * 8 + 6) / 12)


def test_exact_amounts(spark, dims):
    row = featurise(_frame(spark, ["Fe0.5Co0.5"]), *dims, amounts="exact").first()
    assert row.stoicentw == pytest.approx(math.log(2)) and row.groupw == pytest.approx(8.5)
    with pytest.raises(ValueError):
        fx.stoichiometry("parts", ["Fe"], "half")


def test_pair_enthalpy(spark, dims):
    rows = {r.formula: r for r in featurise(_frame(spark, ["Fe2Al", "AlFe2", "FeCoNi", "SmZr", "SmZrFe"]), *dims).collect()}
    assert rows["Fe2Al"].miedemaH == pytest.approx(4 * (2 / 3) * (1 / 3) * (2 - 10 * (1.83 - 1.61) ** 2))
    assert rows["Fe2Al"].miedemaH == pytest.approx(rows["AlFe2"].miedemaH)
    assert rows["FeCoNi"].stoicentw == pytest.approx(math.log(3))
    assert rows["SmZr"].miedemaH is None and rows["SmZrFe"].miedemaH is None


def test_fractions_sum_to_one(spark, dims):
    symbols = dimensions.known_symbols(dims[0])
    parsed = fx.with_parts(_frame(spark, ["Fe3B1", "Fe12Sn3Sb1", "UFe2"]))
    fracs = fx.fractions(fx.stoichiometry("parts", symbols))
    sums = parsed.selectExpr("formula", f"aggregate({fracs}, 0D, (s, p) -> s + p.n) as total").collect()
    assert all(r.total == pytest.approx(1.0) for r in sums)


def test_missing_property_propagates(spark, dims):
    elements = dims[0].withColumn(
        "electronegativity", F.when(F.col("symbol") != "Co", F.col("electronegativity"))
    ).withColumn("group_block", F.when(F.col("symbol") != "Co", F.col("group_block")))
    row = featurise(_frame(spark, ["FeCo"]), elements, dims[1]).first()
    assert row.electronegw is None and row.groupw == 8 and row.Zw == pytest.approx((55.845 + 58.933) / 2)


def test_median_of_kept_rows(spark, dims):
    raw = spark.createDataFrame(
        [("Fe3B", 0.1), ("Fe3B", 0.18), ("Fe3B", 0.5), ("Fe3B", None), ("FeB", 0.1), ("SmZr", 1.0), (None, 1.0), ("?", 1.0)],
        "formula string, ms double",
    )
    rows = build_features(raw, *dims).collect()
    assert [(r.formula, r.ms) for r in rows] == [("Fe3B", pytest.approx(0.34))]


def test_odd_column_names(spark, dims):
    raw = spark.createDataFrame([("Fe3B", 0.5)], "`chemical formula` string, `saturation magnetization` double")
    table = build_features(raw, *dims, "chemical formula", "saturation magnetization")
    assert table.first()["saturation magnetization"] == 0.5
    assert composition.radix_summary(raw, "chemical formula").first().name == "binary"
    assert composition.stoichiometry_table(raw, dims[0], "chemical formula").first().Fe == 3


def test_large_lookup_is_not_broadcast(spark):
    from lodespark.session import bounded_broadcast

    small, large = spark.range(10), spark.range(50)
    plan = lambda d: small.join(bounded_broadcast(d, 20), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(spark.range(15)) and "broadcast" not in plan(large)


def test_feature_plan_shuffles_by_formula_once(spark, dims):
    medians = spark.createDataFrame([("Fe3B", 1.0), ("Fe2B", 2.0)], "formula string, ms double").groupBy("formula").agg(
        F.max("ms").alias("ms")
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = featurise(medians, *dims, carry=["ms"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_exclusion_reads_tokens(spark):
    rows = _frame(spark, ["FeYb2", "Fe(SmCo)2", "FeYO3", "Fe2O3", "Fe100Sm0"])
    kept = exclude_elements(rows, ["Y", "Sm"]).collect()
    assert [r.formula for r in kept] == ["FeYb2", "Fe2O3"]


def test_occurrence_and_radix_names(spark, dims):
    df = _frame(spark, ["FeSi", "FeS", "FeS", "SiS2Fe", None, "FeCoNiMnCrAlSiB"])
    seen = {r.element: (r["count"], r.n_formulas) for r in composition.element_occurrence(df, dims[0]).collect()}
    assert seen["S"] == (3, 2) and seen["Si"] == (3, 3) and seen["Fe"] == (5, 4) and seen["Au"] == (0, 0)
    names = [(r.radix, r.name, r.n_compounds) for r in composition.radix_summary(df).collect()]
    assert names == [(2, "binary", 3), (3, "ternary", 1), (8, "8-component", 1)]


def test_symmetric_pairs(spark):
    wide = spark.createDataFrame([("A", None, 2.0), ("B", None, 5.0)], "element string, A double, B double")
    rows = {(r.a, r.b): r.h for r in dimensions.symmetric_pairs(wide, "element").collect()}
    assert rows == {("A", "A"): 0.0, ("A", "B"): 2.0, ("B", "A"): 2.0, ("B", "B"): 10.0}


def test_unknown_symbols_make_a_formula_unreadable(spark):
    rows = fx.with_parts(spark.createDataFrame([("XxFe",), ("FeCo2",), ("(FeQq)2",)], "formula string"))
    assert [r.parts is None for r in rows.collect()] == [True, False, True]
