"""Composition-weighted features and the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import formula as fx
from lodespark.operators.quantiles import exact_quantiles
from lodespark.session import BROADCAST_ROWS
from lodespark.sources.dimensions import electronegativity_value, group_number, known_symbols

# Feature names in the order of the output table.
FEATURES = [
    "compoundradix",
    "stoicentw",
    "Zw",
    "periodw",
    "groupw",
    "meltingTw",
    "miedemaH",
    "valencew",
    "electronegw",
]
# Targets below this (tesla) are dropped; the value itself stays.
MAGNETIC_CUTOFF = 0.18


def term_lookup(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """One lookup for single elements (``a = b``) and unordered pairs (``a < b``)."""
    single = elements.select(
        F.col("symbol").alias("a"),
        F.col("symbol").alias("b"),
        electronegativity_value(F.col("electronegativity")).alias("en"),
        F.col("atomic_weight").alias("z"),
        group_number(F.col("group_block")).alias("grp"),
        F.col("period").cast("double").alias("per"),
        F.col("melting_point").alias("melt"),
        F.col("valence").cast("double").alias("val"),
    )
    return single.unionByName(pairs.where("a < b").select("a", "b", "h"), allowMissingColumns=True)


def known_terms(elements: DataFrame, pairs: DataFrame) -> tuple[list[str], DataFrame]:
    """Known symbols and the term lookup, hinted for broadcast if it is small enough: one job finds out both."""
    lookup = term_lookup(elements, pairs)
    seen = lookup.select("a", "b").limit(BROADCAST_ROWS + 1).collect()
    if len(seen) > BROADCAST_ROWS:
        return known_symbols(elements), lookup
    return sorted({r.a for r in seen if r.a is not None and r.a == r.b}), F.broadcast(lookup)


def composition_terms(fracs: str) -> str:
    """Weights of a composition: one term per element and one (4 x_a x_b) per unordered pair of elements."""
    term = lambda a, b, w: f"named_struct('a', {a}, 'b', {b}, 'w', {w})"
    single = f"transform(fr, p -> {term('p.el', 'p.el', 'p.n')})"
    pairs = (
        f"flatten(transform(fr, p -> transform(filter(fr, q -> q.el > p.el), q -> {term('p.el', 'q.el', '4D * p.n * q.n')})))"
    )
    return fx.let("fr", fracs, f"concat({single}, {pairs})")


def _weighted(prop: str, out: str) -> Column:
    """Weighted sum over the elements; null as soon as one element lacks the property, 0 for no element."""
    return F.expr(f"if(count_if(a = b and {prop} is null) = 0, coalesce(sum(w * {prop}) filter (where a = b), 0D), null) as {out}")


def featurise(
    formulas: DataFrame,
    elements: DataFrame,
    pairs: DataFrame,
    formula: str = "formula",
    carry: list[str] | None = None,
    amounts: str = "int",
) -> DataFrame:
    """The nine features for every row of ``formulas``, which must hold each formula once.

    Each formula is parsed once and exploded into its element and pair terms; one broadcast join looks all of
    them up and one aggregation by formula folds them back. ``carry`` columns are functions of the formula and
    pass through. When the input is already partitioned by formula the aggregation needs no further shuffle.
    """
    carry = [fx.name(c) for c in carry or []]
    key = fx.name(formula)
    symbols, lookup = known_terms(elements, pairs)
    fracs = fx.fractions(fx.stoichiometry("parts", symbols, amounts))
    terms = (
        fx.with_parts(formulas.select(key, *carry), key)
        .selectExpr(
            key, *carry, f"{fx.radix('parts')} as compoundradix", f"explode_outer({composition_terms(fracs)}) as t"
        )
        .select(key, *carry, "compoundradix", "t.*")
    )
    folded = (
        terms.join(lookup, ["a", "b"], "left")
        .groupBy(key)
        .agg(
            *[F.expr(f"first({c}) as {c}") for c in carry],
            F.expr("cast(first(compoundradix) as double) as compoundradix"),
            F.expr("0D - coalesce(sum(w * ln(w)) filter (where a = b), 0D) as stoicentw"),
            _weighted("z", "Zw"),
            _weighted("per", "periodw"),
            F.expr(
                "try_divide(sum(w * grp) filter (where a = b), sum(w) filter (where a = b and grp is not null)) as groupw"
            ),
            _weighted("melt", "meltingTw"),
            F.expr(
                "if(count_if(a < b and h is null) = 0, coalesce(sum(w * h) filter (where a < b), 0D), null) as miedemaH"
            ),
            _weighted("val", "valencew"),
            _weighted("en", "electronegw"),
        )
    )
    # A formula that cannot be read has no features at all.
    readable = [f"if(compoundradix is null, null, {c}) as {c}" for c in FEATURES if c != "compoundradix"]
    return folded.selectExpr(key, *carry, "compoundradix", *readable)


def drop_missing(df: DataFrame, target: str, features: list[str] = FEATURES) -> DataFrame:
    """Drop rows whose target or any feature is null or NaN."""
    return df.na.drop(subset=[target, *features])


def magnetic_cutoff(df: DataFrame, target: str, cutoff: float = MAGNETIC_CUTOFF) -> DataFrame:
    """Drop targets below the cutoff; the cutoff itself is kept."""
    return df.where(F.col(target) >= F.lit(float(cutoff)))


def median_targets(raw: DataFrame, formula: str, target: str, cutoff: float = MAGNETIC_CUTOFF) -> DataFrame:
    """Exact median target per formula over the rows at or above the cutoff."""
    kept = magnetic_cutoff(raw.select(formula, target).where(F.col(formula).isNotNull()), target, cutoff)
    return exact_quantiles(kept, [formula], target, {target: 0.5}).select(formula, target)


def build_features(
    raw: DataFrame,
    elements: DataFrame,
    pairs: DataFrame,
    formula: str = "formula",
    target: str = "ms",
    cutoff: float = MAGNETIC_CUTOFF,
    amounts: str = "int",
) -> DataFrame:
    """Feature table: one row per formula with the median target and the nine features.

    The cutoff depends on the target alone and the features on the formula alone, so rows are cut and collapsed
    to distinct formulas first, and only those are parsed and looked up. The median of a column that is constant
    within the group is that constant, hence the result is that of featurising every row.
    """
    medians = median_targets(raw, formula, target, cutoff)
    table = featurise(medians, elements, pairs, formula, [target], amounts)
    return drop_missing(table, target)
