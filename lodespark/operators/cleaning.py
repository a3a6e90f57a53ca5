"""Cleaning of tabular exports: renames, coercion, unit conversion, filters and their audit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions.formula import mentions_any, name

# Bohr magnetons per cubic angstrom to tesla is mu_B / 1e-30 * mu_0, about 11.654.
BOHR_MAGNETON = 9.274e-24
CUBIC_ANGSTROM = 1e-30
VACUUM_PERMEABILITY = 4 * math.pi * 1e-7
TESLA_PER_BOHR_DENSITY = BOHR_MAGNETON / CUBIC_ANGSTROM * VACUUM_PERMEABILITY

# Elements whose compounds are left out.
RARE_EARTHS = ["La", "Sc", "Dy", "Sm", "Lu", "Er", "Y", "Pr", "Nd", "Gd", "Tm", "Pm", "Ce", "Tb", "Eu", "Ho", "Yb"]
NON_COMMERCIAL = ["Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf", "Es", "Fm", "Md", "No", "Lr"]


def rename_formula(df: DataFrame, old: str = "composition", new: str = "formula") -> DataFrame:
    return df.withColumnRenamed(old, new)


def lenient_double(text: Column) -> Column:
    """Number in a text, null when it is none."""
    return text.try_cast("double")


def to_tesla(bohr_density: Column) -> Column:
    """Magnetic moment density in Bohr magnetons per cubic angstrom to saturation magnetization in tesla."""
    return bohr_density * F.lit(TESLA_PER_BOHR_DENSITY)


def keep_magnetic(df: DataFrame, flag: str = "is_magnetic") -> DataFrame:
    return df.where(F.col(flag))


def exclude_elements(df: DataFrame, symbols: list[str], formula: str = "formula") -> DataFrame:
    """Drop rows whose formula mentions one of the elements: one predicate, one pass."""
    return df.where(f"not {mentions_any(name(formula), symbols)}")


def clean_export(
    df: DataFrame,
    composition: str = "composition",
    moment: str = "total_magnetization_normalized_vol",
    formula: str = "formula",
    target: str = "ms",
) -> DataFrame:
    """Export rows to (formula, target): magnetic compounds without rare earths or non-commercial elements."""
    kept = keep_magnetic(rename_formula(df.select(composition, moment, "is_magnetic"), composition, formula))
    kept = exclude_elements(kept, RARE_EARTHS + NON_COMMERCIAL, formula)
    return kept.select(formula, to_tesla(lenient_double(F.col(moment))).alias(target))


def cleaning_audit(df: DataFrame, composition: str = "composition") -> DataFrame:
    """Rows before and after each filter of :func:`clean_export`, in one pass over the data.

    Rows are first counted per distinct composition, so each formula is tested once.
    """
    counts = df.groupBy(composition).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_magnetic").alias("n_magnetic")
    )
    # Null for a null composition, which the filters drop.
    rare = F.expr(mentions_any(name(composition), RARE_EARTHS))
    scarce = F.expr(mentions_any(name(composition), NON_COMMERCIAL))
    total = lambda name, col: F.coalesce(F.sum(col), F.lit(0)).cast("bigint").alias(name)
    wide = counts.agg(
        total("initial", F.col("n")),
        total("magnetic", F.col("n_magnetic")),
        total("without_rare_earth", F.when(~rare, F.col("n_magnetic"))),
        total("without_non_commercial", F.when(~rare & ~scarce, F.col("n_magnetic"))),
    )
    steps = ["initial", "magnetic", "without_rare_earth", "without_non_commercial"]
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("bigint").alias("step_no"),
                        F.lit(step).alias("step"),
                        F.col(step).alias("n_rows"),
                        (F.col(steps[max(i - 1, 0)]) - F.col(step)).alias("n_dropped"),
                    )
                    for i, step in enumerate(steps)
                ]
            )
        )
    )
