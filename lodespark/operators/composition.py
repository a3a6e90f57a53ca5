"""Composition tables: stoichiometry and fraction views, element occurrence, radix summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import formula as fx
from lodespark.session import bounded_broadcast
from lodespark.sources.dimensions import known_symbols

# Names of compounds by number of elements.
RADIX_NAMES = {2: "binary", 3: "ternary", 4: "quaternary", 5: "quinary", 6: "senary", 7: "septenary"}


def formula_counts(df: DataFrame, formula: str = "formula") -> DataFrame:
    """Distinct formulas with row counts; combined before the shuffle, so a common formula costs nothing."""
    return df.groupBy(formula).agg(F.count(F.lit(1)).alias("n_rows"))


def stoichiometry_table(formulas: DataFrame, elements: DataFrame, formula: str = "formula") -> DataFrame:
    """Wide, zero-filled whole-number amounts: one column per element of the dimension, others left out.

    Row-local: the columns are read from the parsed composition, without a pivot or a shuffle.
    """
    symbols = known_symbols(elements)
    stoich = fx.stoichiometry(fx.parse_parts(fx.name(formula)), symbols)
    wide = formulas.selectExpr(fx.name(formula), f"explode(array({fx.parts_map(stoich)})) as m")
    return wide.selectExpr(
        fx.name(formula), *[f"cast(coalesce(element_at(m, {fx.text(s)}), 0) as bigint) as {s}" for s in symbols]
    )


def atomic_fraction_table(formulas: DataFrame, elements: DataFrame, formula: str = "formula") -> DataFrame:
    """Wide atomic fractions: one column per element, null where the element is absent."""
    symbols = known_symbols(elements)
    fracs = fx.fractions(fx.stoichiometry(fx.parse_parts(fx.name(formula)), symbols))
    wide = formulas.selectExpr(fx.name(formula), f"explode(array({fx.parts_map(fracs)})) as m")
    return wide.selectExpr(fx.name(formula), *[f"element_at(m, {fx.text(s)}) as {s}" for s in symbols])


def element_occurrence(df: DataFrame, elements: DataFrame, formula: str = "formula") -> DataFrame:
    """Mentions of each element over all formulas, and formulas that mention it; 0 for elements never seen.

    Symbols are whole tokens, so ``S`` is not found inside ``Si``. Rows are counted per distinct formula first.
    """
    tokens = fx.symbol_tokens(fx.name(formula))
    mentions = (
        formula_counts(df.where(F.col(formula).isNotNull()), formula)
        .selectExpr("n_rows", f"explode(array({tokens})) as tokens")
        .selectExpr("n_rows", "tokens", "explode(array_distinct(tokens)) as symbol")
        .join(bounded_broadcast(elements.select("symbol").distinct()), "symbol")
        .groupBy("symbol")
        .agg(
            F.expr("sum(n_rows * size(filter(tokens, t -> t = symbol))) as n"), F.count(F.lit(1)).alias("n_formulas")
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return (
        elements.select("symbol")
        .join(mentions, "symbol", "left")
        .select(F.col("symbol").alias("element"), zero("n").alias("count"), zero("n_formulas").alias("n_formulas"))
        .orderBy(F.length("element").desc(), "element")
    )


def radix_name(n: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RADIX_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, n), F.concat(n.cast("string"), F.lit("-component")))


def radix_summary(df: DataFrame, formula: str = "formula") -> DataFrame:
    """Rows by number of elements, ascending, with the usual names."""
    counts = fx.with_parts(formula_counts(df, formula), formula)
    return (
        counts.where(F.col("parts").isNotNull())
        .groupBy(F.size("parts").alias("radix"))
        .agg(F.sum("n_rows").cast("bigint").alias("n_compounds"))
        .select("radix", radix_name(F.col("radix")).alias("name"), "n_compounds")
        .orderBy("radix")
    )
