"""Exact holdout and K-fold splits without a single-partition sort."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodespark.session import checkpointed

# Hex digits of the hash that make a bucket: 4,096 buckets.
BUCKET_DIGITS = 3


def feature_columns(df: DataFrame, target: str = "ms", formula: str = "formula") -> list[str]:
    """All columns but the target and the formula, in table order."""
    return [c for c in df.columns if c not in (target, formula)]


def features_and_target(df: DataFrame, target: str = "ms", formula: str = "formula") -> DataFrame:
    """Features and target, formula dropped."""
    return df.select(*feature_columns(df, target, formula), target)


def align_features(
    train: DataFrame, test: DataFrame, target: str = "ms", formula: str = "formula"
) -> tuple[DataFrame, DataFrame, list[str]]:
    """A training and a foreign test table with the same feature columns, in the order of training."""
    features = feature_columns(train, target, formula)
    missing = sorted(set(features) - set(test.columns))
    if missing:
        raise ValueError(f"the test table lacks the features {', '.join(missing)}")
    keep = lambda df: [c for c in (formula,) if c in df.columns] + features + [target]
    return train.select(*keep(train)), test.select(*keep(test)), features


def shuffle_hash(key: Column, seed: Column) -> Column:
    """Seeded hash by which rows are put in random order."""
    return F.md5(F.concat(key, F.lit("#"), seed.cast("string")))


def hash_rank(
    df: DataFrame, key: str, seed: Column, groups: list[str] | None = None, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Zero-based rank of each row in seeded hash order, and the number of rows: ``_rank`` and ``_n``.

    Rows are ranked within buckets of the hash's leading digits and the buckets' counts give the offsets, so no
    task sees more than a few thousandths of the rows. ``key`` must be unique within each group. The offsets have
    at most ``16 ** digits`` rows per group.
    """
    groups = groups or []
    hashed = df.withColumn("_hash", shuffle_hash(F.col(key), seed)).withColumn(
        "_hbucket", F.substring("_hash", 1, digits)
    )
    sizes = hashed.groupBy(*groups, "_hbucket").agg(F.count(F.lit(1)).alias("_size"))
    group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = group.orderBy("_hbucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(
        *groups,
        "_hbucket",
        (F.sum("_size").over(before) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(group).alias("_n"),
    )
    inside = W.partitionBy(*groups, "_hbucket").orderBy("_hash", key)
    return (
        hashed.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*groups, "_hbucket"])
        .withColumn("_rank", F.col("_offset") + F.col("_row") - 1)
        .drop("_hash", "_hbucket", "_offset", "_row")
    )


def ordered_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Zero-based rank in the order of columns, and the number of rows: ``_rank`` and ``_n``.

    Range partitions are sampled, so they are materialised once; their counts then give the offsets.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    whole = W.partitionBy(F.lit(0))
    before = whole.orderBy("_pid").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(
        "_pid", (F.sum("_size").over(before) - F.col("_size")).alias("_offset"), F.sum("_size").over(whole).alias("_n")
    )
    return (
        ranged.withColumn("_row", F.row_number().over(W.partitionBy("_pid").orderBy(*order)))
        .join(offsets, "_pid")
        .withColumn("_rank", F.col("_offset") + F.col("_row") - 1)
        .drop("_pid", "_offset", "_row")
    )


def fold_of_rank(rank: Column, n: Column, k: int) -> Column:
    """Fold (1..k) of a rank: contiguous folds of which the first ``n mod k`` have one row more."""
    small, extra = F.floor(n / k), n % k
    head = extra * (small + 1)
    return (
        F.when(rank < head, F.floor(rank / (small + 1)))
        .otherwise(extra + F.floor(F.try_divide(rank - head, small)))
        .cast("int")
        + 1
    )


def _kept(df: DataFrame) -> DataFrame:
    """Ranking goes over its rows twice; kept, the plan behind them runs once. The cache is the caller's to clear."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def holdout_split(
    df: DataFrame, key: str = "formula", train_size: float = 0.8, seed: int = 0
) -> DataFrame:
    """Mark ``floor(train_size * n)`` rows as training, the rest as held out: column ``is_train``."""
    ranked = hash_rank(_kept(df), key, F.lit(seed))
    return ranked.withColumn("is_train", F.col("_rank") < F.floor(F.lit(train_size) * F.col("_n"))).drop("_rank", "_n")


def kfold(df: DataFrame, k: int, key: str = "formula", seed: int | None = 0) -> DataFrame:
    """Add ``fold`` (1..k): shuffled by the seed, or contiguous in key order when the seed is None."""
    ranked = ordered_rank(df, [key]) if seed is None else hash_rank(_kept(df), key, F.lit(seed))
    return ranked.withColumn("fold", fold_of_rank(F.col("_rank"), F.col("_n"), k)).drop("_rank", "_n")


def repeated_kfold(df: DataFrame, k: int, seeds: list[int], key: str = "formula") -> DataFrame:
    """One shuffled K-fold assignment for every seed: columns ``seed`` and ``fold``.

    Only keys are copied and ranked per seed; a row meets its folds in one join and is copied in place.
    """
    if not seeds:
        raise ValueError("at least one seed is required")
    rows = _kept(df)
    copies = rows.select(key, F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    ranked = hash_rank(copies, key, F.col("seed"), ["seed"])
    fold = F.struct("seed", fold_of_rank(F.col("_rank"), F.col("_n"), k).alias("fold"))
    folds = ranked.groupBy(key).agg(F.collect_list(fold).alias("_folds"))
    return rows.join(folds, key).select(*df.columns, F.inline("_folds"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
