"""Paired significance tests on fold metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodespark.functions.pvalues import signed_rank_pvalue, t_pvalue
from lodespark.operators.metrics import METRICS


def paired_differences(
    folds: DataFrame, a: str, b: str, metrics: list[str] = METRICS, by: list[str] | None = None
) -> DataFrame:
    """Long (metric, fold, d) differences of two models.

    Raises if a model is unknown, or if the two do not have equally many folds in each group of ``by``; ``folds`` has
    a row per model and fold, so this is one small job.
    """
    by = by or []
    count = lambda m: F.count_if(F.col("model") == m)
    sizes = folds.groupBy(*by).agg(count(a).alias("_a"), count(b).alias("_b")).collect()
    for m, side in ((a, "_a"), (b, "_b")):
        if not any(r[side] for r in sizes):
            raise ValueError(f"no fold results of the model {m}")
    if any(r["_a"] != r["_b"] for r in sizes):
        raise ValueError(f"{a} and {b} differ in their number of folds")
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    long = folds.where(F.col("model").isin(a, b)).unpivot([*by, "model", "fold"], metrics, "metric", "value")
    paired = long.groupBy(*by, "metric", "fold").agg(side(a).alias("va"), side(b).alias("vb"))
    d = F.col("va") - F.col("vb")
    return paired.select(*by, "metric", "fold", d.alias("d")).where(F.col("d").isNotNull() & ~F.isnan("d"))


def paired_t(diffs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Paired t statistic ``mean(d) / (std(d) / sqrt(n))`` and its two-sided p-value."""
    by = by or []
    stats = diffs.groupBy(*by, "metric").agg(
        F.count("d").alias("n"), F.avg("d").alias("_mean"), F.stddev_samp("d").alias("_std")
    )
    t = F.try_divide(F.col("_mean"), F.col("_std") / F.sqrt("n"))
    return stats.select(*by, "metric", "n", t.alias("t")).withColumn("p", t_pvalue("t", (F.col("n") - 1).cast("double")))


def wilcoxon(diffs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wilcoxon signed-rank W and two-sided p-value; zero differences are dropped, W is null if none remain.

    The windows hold the folds of one comparison, never data rows.
    """
    by = by or []
    side = [*by, "metric", "_counts"]
    ranked = (
        diffs.withColumn("_counts", F.col("d") != 0)
        .withColumn("_size", F.abs("d"))
        .withColumn("_ties", F.count(F.lit(1)).over(W.partitionBy(*side, "_size")))
        .withColumn("_rank", F.rank().over(W.partitionBy(*side).orderBy("_size")) + (F.col("_ties") - 1) / 2)
    )
    sums = ranked.groupBy(*by, "metric").agg(
        F.count_if("_counts").alias("n"),
        F.count_if(~F.col("_counts")).cast("double").alias("_zeros"),
        F.expr("coalesce(sum(_rank) filter (where d > 0), 0D)").alias("_plus"),
        F.expr("coalesce(sum(_rank) filter (where d < 0), 0D)").alias("_minus"),
        F.expr("coalesce(sum(cast(_ties * _ties - 1 as double)) filter (where _counts), 0D)").alias("_tie_term"),
    )
    w = F.when(F.col("n") > 0, F.least("_plus", "_minus"))
    return sums.withColumn("w", w).select(
        *by,
        "metric",
        "n",
        "w",
        signed_rank_pvalue("w", F.col("n").cast("double"), "_zeros", "_tie_term").alias("p"),
    )
