"""Distribution summaries of the target by element group: histograms, densities, violins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions.formula import contains_element, name
from lodespark.operators.quantiles import exact_quantiles

# Element groups and the histogram of the target (tesla).
GROUPS = ["Fe", "Co", "Cr", "Mn"]
BIN_WIDTH = 0.2
N_BINS = 12
HISTOGRAM_GRID = 200
VIOLIN_GRID = 100
VIOLIN_CUT = 2.0
# Bandwidths beyond which a value is left out of a density: its term is under 3e-18 of the kernel's peak there.
REACH = 9.0


def _groups(formula: str) -> dict[str, Column]:
    return {"all": F.lit(True), **{g: F.expr(contains_element(name(formula), g)) for g in GROUPS}}


def fixed_bin(value: Column, width: float = BIN_WIDTH, n_bins: int = N_BINS) -> Column:
    """Bin 0..n-1 by the edges ``i * width`` as doubles; last bin closed, outside null.

    The quotient only proposes a bin; comparing with the edges settles values that lie on one.
    """
    guess = F.floor(value / F.lit(width))
    guess = guess - (value < guess * F.lit(width)).cast("int")
    guess = guess + (value >= (guess + 1) * F.lit(width)).cast("int")
    last = F.lit(n_bins) * F.lit(width)
    inside = (value >= 0.0) & (value <= last)
    return F.when(inside, F.least(guess, F.lit(n_bins - 1))).cast("bigint")


def group_histogram(df: DataFrame, formula: str = "formula", target: str = "ms") -> DataFrame:
    """Zero-filled counts by element group over fixed bins; groups overlap.

    One aggregation by bin with a conditional count per group: rows are not multiplied by their groups.
    """
    groups = {g: c for g, c in _groups(formula).items() if g != "all"}
    counts = (
        df.withColumn("bin", fixed_bin(F.col(target)))
        .where("bin is not null")
        .groupBy("bin")
        .agg(*[F.count_if(c).alias(g) for g, c in groups.items()])
        .unpivot("bin", list(groups), "grp", "n")
    )
    edges = df.sparkSession.range(N_BINS).select(F.col("id").alias("bin"))
    frame = edges.select("bin", F.explode(F.lit(list(groups))).alias("grp"))
    return frame.join(counts, ["grp", "bin"], "left").select(
        "grp",
        "bin",
        (F.col("bin") * F.lit(BIN_WIDTH)).alias("lo"),
        ((F.col("bin") + 1) * F.lit(BIN_WIDTH)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def auto_bins(df: DataFrame, target: str = "ms") -> DataFrame:
    """One row with the automatic binning: width is the smaller of Freedman-Diaconis and Sturges.

    A zero interquartile range leaves Sturges alone.
    """
    quant = exact_quantiles(df, [], target, {"lo": 0.0, "q1": 0.25, "q3": 0.75, "hi": 1.0})
    spread = F.col("hi") - F.col("lo")
    fd = F.lit(2.0) * (F.col("q3") - F.col("q1")) / F.pow(F.col("n"), F.lit(1.0 / 3.0))
    sturges = spread / (F.log2("n") + 1)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    n_bins = F.when(width > 0, F.ceil(spread / width)).otherwise(1).cast("bigint")
    return quant.select(
        F.when(spread > 0, F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
        F.when(spread > 0, F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"),
        n_bins.alias("n_bins"),
    )


def auto_histogram(df: DataFrame, target: str = "ms") -> DataFrame:
    """Zero-filled histogram of all targets with automatic bins, which enter as a scalar subquery."""
    # Exploded, so that the optimizer does not copy the subquery into every reference to the bins.
    spec = F.explode(F.array(auto_bins(df, target).select(F.struct("lo", "hi", "n_bins").alias("spec")).scalar()))
    step = (F.col("b.hi") - F.col("b.lo")) / F.col("b.n_bins")
    edge = lambda i: F.col("b.lo") + i * step
    guess = F.floor((F.col(target) - F.col("b.lo")) / step)
    guess = guess - (F.col(target) < edge(guess)).cast("int")
    guess = guess + (F.col(target) >= edge(guess + 1)).cast("int")
    counts = (
        df.where(F.col(target).isNotNull() & ~F.isnan(target))
        .groupBy(target)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("*", spec.alias("b"))
        .select(F.least(guess, F.col("b.n_bins") - 1).cast("bigint").alias("bin"), "n")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    frame = df.sparkSession.range(1).select(spec.alias("b")).where("b is not null").select(
        "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b.n_bins") - 1)).alias("bin")
    )
    frame = frame.select(
        "bin",
        edge(F.col("bin")).alias("lo"),
        F.when(F.col("bin") == F.col("b.n_bins") - 1, F.col("b.hi")).otherwise(edge(F.col("bin") + 1)).alias("hi"),
    )
    return frame.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def grouped_values(df: DataFrame, formula: str = "formula", target: str = "ms") -> DataFrame:
    """Distinct (group, value) with counts: rows are combined before they are multiplied by their groups."""
    groups = _groups(formula)
    flags = [F.coalesce(c, F.lit(False)).alias(g) for g, c in groups.items()]
    combined = (
        df.where(F.col(target).isNotNull() & ~F.isnan(target))
        .select(F.col(target).alias("value"), *flags)
        .groupBy("value", *groups)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    member = F.array_compact(F.array(*[F.when(F.col(g), F.lit(g)) for g in groups]))
    return combined.select(F.explode(member).alias("grp"), "value", "n").groupBy("grp", "value").agg(
        F.sum("n").alias("n")
    )


def _bandwidths(values: DataFrame) -> DataFrame:
    """Size, range and Scott bandwidth of every group; groups without spread have no density.

    Weighted moments around the group mean come from the sums of the combined values.
    """
    sums = values.groupBy("grp").agg(
        F.sum("n").alias("size"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    spread = (
        values.join(F.broadcast(sums), "grp")
        .groupBy("grp")
        .agg(
            F.first("size").alias("size"),
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
            F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2).alias("ss"),
        )
    )
    return spread.where((F.col("size") > 1) & (F.col("ss") > 0)).select(
        "grp",
        "size",
        "lo",
        "hi",
        (F.sqrt(F.col("ss") / (F.col("size") - 1)) * F.pow("size", F.lit(-0.2))).alias("bw"),
    )


def density(
    df: DataFrame, formula: str = "formula", target: str = "ms", grid: int = HISTOGRAM_GRID, cut: float = 0.0
) -> DataFrame:
    """Gaussian kernel density of every group on an even grid that ends ``cut`` bandwidths past the data.

    Values are combined first. Each combined value then meets the grid points within ``REACH`` bandwidths inside its
    own task and is summed there, so only (group, grid point) partial sums are shuffled; what is left out is under
    3e-18 of the kernel's peak for each point, whatever the data. A group's smallest value meets its whole grid, so no
    point is missing where nothing is near. At most five groups are broadcast.
    """
    values = grouped_values(df, formula, target)
    bands = _bandwidths(values).select(
        "grp",
        "size",
        "bw",
        F.col("lo").alias("_least"),
        (F.col("lo") - F.lit(cut) * F.col("bw")).alias("lo"),
        (F.col("hi") + F.lit(cut) * F.col("bw")).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(grid - 1.0)
    x = F.col("lo") + F.col("i") * step
    near = lambda side: (F.col("value") + F.lit(side * REACH) * F.col("bw") - F.col("lo")) / step
    whole = F.col("value") == F.col("_least")
    first = F.when(whole, F.lit(0)).otherwise(F.greatest(F.ceil(near(-1)).cast("int"), F.lit(0)))
    last = F.when(whole, F.lit(grid - 1)).otherwise(F.least(F.floor(near(1)).cast("int"), F.lit(grid - 1)))
    kernel = F.col("n") * F.exp(F.lit(-0.5) * ((x - F.col("value")) / F.col("bw")) ** 2)
    scale = F.col("size") * F.col("bw") * F.sqrt(F.lit(2.0) * F.pi())
    return (
        values.join(F.broadcast(bands), "grp")
        .select("*", first.alias("_first"), last.alias("_last"))
        .where("_first <= _last")
        .select("*", F.explode(F.sequence("_first", "_last")).alias("i"))
        .groupBy("grp", "i", "lo", "hi", "bw", "size")
        .agg(F.sum(kernel).alias("_sum"))
        .select("grp", F.col("i").cast("bigint").alias("i"), x.alias("x"), (F.col("_sum") / scale).alias("density"))
    )


def violin_quartiles(df: DataFrame, formula: str = "formula", target: str = "ms") -> DataFrame:
    """Quartile lines of the violins, one row per overlapping group."""
    return exact_quantiles(
        grouped_values(df, formula, target), ["grp"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, "n"
    )


def violin_density(df: DataFrame, formula: str = "formula", target: str = "ms") -> DataFrame:
    """Violin outlines: 100 points, two bandwidths beyond the data."""
    return density(df, formula, target, VIOLIN_GRID, VIOLIN_CUT)


def long_groups(df: DataFrame, formula: str = "formula", target: str = "ms") -> DataFrame:
    """The stacked (group, value) rows behind the violins, for export."""
    groups = _groups(formula)
    member = F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in groups.items()]))
    return df.select(F.explode(member).alias("grp"), F.col(target).alias("value"))
