"""Feature attribution: permutation importance and Shapley values."""

from __future__ import annotations

from math import factorial
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodespark.operators.splits import hash_rank, shuffle_hash

REPEATS = 10
BACKGROUND_ROWS = 100
# Every coalition is evaluated, so their number doubles with each feature.
MAX_EXACT_FEATURES = 12


def permutation_scores(
    model: Any,
    df: DataFrame,
    features: list[str],
    target: str = "ms",
    key: str = "formula",
    repeats: int = REPEATS,
    seed: int = 0,
) -> DataFrame:
    """R2 lost by permuting one feature, for every (feature, repeat).

    In each repeat the rows are ranked in a hash order and meet the row with that rank in a common order: an
    equi-join on ranks of narrow keys. The variants, one per feature, are made from the pair of rows in place, and all
    are scored in one pass.
    """
    rows = df.select(key, *features, target).persist(StorageLevel.MEMORY_AND_DISK)
    donors = hash_rank(rows, key, F.lit(f"{seed}/donor")).select(
        "_rank", F.array(*features).alias("_donor")
    )
    copies = rows.select(key, F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat"))
    order = F.concat_ws("/", F.lit(str(seed)), F.col("repeat").cast("string"))
    orders = hash_rank(copies, key, order, ["repeat"]).select(key, "repeat", "_rank")
    pairs = orders.join(donors, "_rank").join(rows, key)
    slots = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("_donor", F.lit(j)).alias("_other")) for j, f in enumerate(features)])
    permuted = pairs.select("repeat", target, *features, F.inline(slots)).select(
        "feature",
        "repeat",
        target,
        *[F.when(F.col("feature") == f, F.col("_other")).otherwise(F.col(f)).alias(f) for f in features],
    )
    original = rows.select(
        F.lit("").alias("feature"), F.lit(-1).alias("repeat"), target, *features
    )
    error = F.col(target) - F.col("prediction")
    scored = (
        model.transform(permuted.unionByName(original))
        .groupBy("feature", "repeat")
        .agg((F.lit(1.0) - F.sum(error * error) / (F.var_pop(target) * F.count(target))).alias("_r2"))
    )
    # One row per (feature, repeat) is left here, so the unpartitioned window is small by construction.
    base = F.max(F.when(F.col("feature") == "", F.col("_r2"))).over(W.partitionBy(F.lit(0)))
    return (
        scored.withColumn("_base", base)
        .where("feature <> ''")
        .select("feature", "repeat", (F.col("_base") - F.col("_r2")).alias("importance"))
    )


def permutation_importance(model: Any, df: DataFrame, features: list[str], **kwargs: Any) -> DataFrame:
    """Mean and spread of the permutation scores, least important feature first."""
    return (
        permutation_scores(model, df, features, **kwargs)
        .groupBy("feature")
        .agg(F.avg("importance").alias("importance_mean"), F.stddev_pop("importance").alias("importance_std"))
        .orderBy("importance_mean", "feature")
    )


def background_rows(
    df: DataFrame, features: list[str], key: str = "formula", size: int = BACKGROUND_ROWS, seed: int = 0
) -> list[list[float]]:
    """A sample of background rows, the first in seeded hash order: a bounded top-k."""
    picked = df.orderBy(shuffle_hash(F.col(key), F.lit(seed)), key).select(*features).limit(size).collect()
    return [[float(v) for v in row] for row in picked]


def shapley_values(
    model: Any,
    df: DataFrame,
    background: list[list[float]],
    features: list[str],
    key: str = "formula",
) -> DataFrame:
    """Exact Shapley attribution of every row against a background, for any model.

    Every coalition keeps the row's own values for its features and takes the others from a background row.
    Features in which the two rows agree change nothing, so coalitions run over the differing ones only, with the
    weights of that smaller game. Replicas are made, scored and folded inside the row's own task; only
    (row, features) sums are shuffled. ``base_value`` is the mean background prediction; the attributions sum to
    prediction minus base.
    """
    p = len(features)
    if p > MAX_EXACT_FEATURES:
        raise ValueError(f"exact attribution takes at most {MAX_EXACT_FEATURES} features")
    # Weight of a coalition of s others in a game of d features, at position d * (p + 1) + s.
    weight = [
        factorial(s) * factorial(d - s - 1) / factorial(d) if s < d else 0.0 for d in range(p + 1) for s in range(p + 1)
    ]
    donors = F.array(*[F.array(*[F.lit(v) for v in row]) for row in background])
    differs = F.array_compact(
        F.array(*[F.when(~F.col(f).eqNullSafe(F.get("_bg", F.lit(j))), F.lit(j)) for j, f in enumerate(features)])
    )
    replicas = (
        df.select(key, *features)
        .select("*", F.explode(donors).alias("_bg"))
        .withColumn("_differs", differs)
        .select("*", F.expr("explode(sequence(0, shiftleft(1, size(_differs)) - 1))").alias("_mask"))
    )
    # Position of a feature among the differing ones, from 1; 0 when it does not differ.
    slot = lambda j: F.array_position("_differs", F.lit(j)).cast("int")
    member = lambda j: F.expr(f"shiftright(_mask, cast(array_position(_differs, {j}) as int) - 1) & 1") == 1
    mixed = replicas.select(
        key,
        "_mask",
        F.size("_differs").alias("_d"),
        *[
            F.when((slot(j) > 0) & ~member(j), F.get("_bg", F.lit(j))).otherwise(F.col(f)).alias(f)
            for j, f in enumerate(features)
        ],
        # +1 for a member, -1 for a differing feature outside, 0 otherwise.
        *[
            F.when(slot(j) == 0, F.lit(0)).when(member(j), F.lit(1)).otherwise(F.lit(-1)).alias(f"_sign{j}")
            for j in range(p)
        ],
    )
    scored = model.transform(mixed).withColumn("_size", F.bit_count("_mask"))
    weights = F.array(*[F.lit(w) for w in weight])
    others = lambda j: F.col("_size") - F.greatest(F.col(f"_sign{j}"), F.lit(0))

    def share(j: int):
        factor = F.col(f"_sign{j}") * F.get(weights, F.col("_d") * (p + 1) + others(j))
        return F.sum(factor * F.col("prediction")) / F.lit(float(len(background)))

    return scored.groupBy(key).agg(
        F.avg(F.when(F.col("_mask") == 0, F.col("prediction"))).alias("base_value"),
        F.avg(F.when(F.col("_size") == F.col("_d"), F.col("prediction"))).alias("prediction"),
        *[share(j).alias(f"phi_{f}") for j, f in enumerate(features)],
    )


def linear_shapley_values(
    model: Any, df: DataFrame, background: DataFrame, features: list[str], key: str = "formula"
) -> DataFrame:
    """Shapley values of a linear model against all rows of ``background``: ``w (x - mean(x))``, from one pass."""
    means = background.agg(*[F.avg(f) for f in features]).first()
    weights = [float(w) for w in model.fit.coefficients]
    phi = [F.lit(w) * (F.col(f) - F.lit(float(m))) for f, w, m in zip(features, weights, means)]
    base = model.fit.intercept + sum(w * float(m) for w, m in zip(weights, means))
    return model.transform(df).select(
        key,
        F.lit(float(base)).alias("base_value"),
        "prediction",
        *[p.alias(f"phi_{f}") for f, p in zip(features, phi)],
    )


def shapley_summary(values: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    wide = values.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in features])
    return wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_phi")) for f in features])
        )
    ).orderBy(F.desc("mean_abs_phi"), "feature")
