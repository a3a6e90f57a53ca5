"""Alloy series: features and predictions along a composition axis, beside measured curves."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.functions import formula as fx
from lodespark.operators.features import FEATURES, featurise
from lodespark.session import inline_table
from lodespark.sources.dimensions import known_symbols

# The alloys of each series.
SERIES = {
    "FeAl": [
        "Fe93Al2", "Fe96Al4", "Fe94Al6", "Fe93Al7", "Fe90Al10", "Fe88Al12", "Fe85Al15",
        "Fe82Al18", "Fe78Al22", "Fe75Al25", "Fe72Al28", "Fe68Al32", "Fe66Al34",
    ],
    "FeCo": [
        "Fe100Co0", "Fe96Co4", "Fe92Co8", "Fe90Co10", "Fe88Co12", "Fe85Co15", "Fe82Co18",
        "Fe79Co21", "Fe71Co29", "Fe59Co41", "Fe45Co55", "Fe26Co74", "Fe7Co93",
    ],
    "FeCr": [
        "Fe99Cr1", "Fe98Cr2", "Fe96Cr4", "Fe95Cr5", "Fe93Cr7", "Fe92Cr8", "Fe91Cr9",
        "Fe90Cr10", "Fe89Cr11", "Fe87Cr13", "Fe85Cr15", "Fe83Cr17", "Fe80Cr20",
    ],
}
# Measured saturation magnetization (tesla) by atomic fraction of the minor element.
LITERATURE = {
    "FeAl": [
        (0.02, 2.14), (0.038, 2.12), (0.058, 2.09), (0.074, 2.05), (0.099, 2.01), (0.124, 1.98), (0.152, 1.92),
        (0.183, 1.86), (0.219, 1.80), (0.251, 1.75), (0.281, 1.69), (0.315, 1.65), (0.341, 1.60),
    ],
    "FeCo": [
        (0.00, 2.18), (0.04, 2.21), (0.08, 2.24), (0.10, 2.26), (0.12, 2.30), (0.15, 2.33), (0.18, 2.36),
        (0.21, 2.39), (0.29, 2.43), (0.41, 2.44), (0.55, 2.31), (0.74, 2.09), (0.93, 1.8),
    ],
    "FeCr": [
        (0.01, 2.14), (0.02, 2.095), (0.04, 2.00), (0.05, 1.96), (0.07, 1.92), (0.08, 1.89), (0.09, 1.86),
        (0.10, 1.83), (0.11, 1.78), (0.13, 1.73), (0.15, 1.66), (0.17, 1.60),
    ],
}
# Element on the axis of each series.
MINOR = {"FeAl": "Al", "FeCo": "Co", "FeCr": "Cr"}

_TEXT, _NUMBER = T.StringType(), T.DoubleType()


def series_formulas(spark: SparkSession, systems: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("system", _TEXT), T.StructField("formula", _TEXT)])
    return inline_table(spark, schema, [(s, f) for s in systems for f in SERIES[s]])


def literature_curve(spark: SparkSession, systems: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("system", _TEXT), T.StructField("x", _NUMBER), T.StructField("value", _NUMBER)])
    return inline_table(spark, schema, [(s, x, v) for s in systems for x, v in LITERATURE[s]])


def series_features(elements: DataFrame, pairs: DataFrame, systems: list[str]) -> DataFrame:
    """System, formula, minor-element fraction ``x`` (null where that element is absent) and the features.

    Nothing is dropped or collapsed.
    """
    spark = elements.sparkSession
    formulas = series_formulas(spark, systems)
    symbols = known_symbols(elements)
    fracs = fx.fractions(fx.stoichiometry(fx.parse_parts("formula"), symbols))
    minor = "map(" + ", ".join(f"{fx.text(s)}, {fx.text(e)}" for s, e in MINOR.items()) + ")"
    x = F.expr(f"element_at({fx.parts_map(fracs)}, element_at({minor}, system))")
    return featurise(formulas.withColumn("x", x), elements, pairs, "formula", ["system", "x"]).select(
        "system", "formula", "x", *FEATURES
    )


def case_studies(
    systems: list[str], models: dict[str, Any], elements: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Predictions of every model along the series: (system, formula, x, source, value).

    The features are built once; every model adds its column in the same pass.
    """
    data = series_features(elements, pairs, systems)
    for name, model in models.items():
        data = model.transform(data).withColumnRenamed("prediction", name)
    return data.unpivot(["system", "formula", "x"], list(models), "source", "value")


def comparison_table(models: dict[str, Any], elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """All series: model predictions and measured values in long form (system, x, source, value)."""
    predicted = case_studies(list(SERIES), models, elements, pairs).drop("formula")
    measured = literature_curve(elements.sparkSession, list(SERIES)).withColumn("source", F.lit("literature"))
    return predicted.unionByName(measured)
