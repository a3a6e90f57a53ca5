"""Fitted trees as tables: one row per node, scored by joins level by level, cut shorter, and checked split by split.

A model's nodes are read from its saved form: (tree, weight, node, value, rows, feature, threshold, left, right). At a
leaf ``feature`` and what follows are null; a row goes left if its feature is at most the threshold. ``rows`` counts the
training rows of the node, as often as they were drawn. ``weight`` is what a tree's value counts in the prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodespark.session import checkpointed, scratch_path

# Levels that are joined in one plan before the rows on their way are checkpointed.
LEVELS_A_PLAN = 4


def node_table(model: Any, spark: SparkSession, average: bool) -> DataFrame:
    """The nodes of a fitted forest (``average``) or boosted chain."""
    path = scratch_path(spark, "tree-model")
    model.stage.write().save(path)
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "settings", "stored")
    weight = F.lit(1.0 / model.stage.getNumTrees) if average else F.col("stored")
    n = F.col("nodeData")
    inner = n.leftChild >= 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n.id.alias("node"),
        n.prediction.alias("value"),
        n.rawCount.alias("rows"),
        F.when(inner, n.split.featureIndex).alias("feature"),
        F.when(inner, F.element_at(n.split.leftCategoriesOrThreshold, 1)).alias("threshold"),
        F.when(inner, n.leftChild).alias("left"),
        F.when(inner, n.rightChild).alias("right"),
    )
    return nodes.join(trees.select("tree", weight.alias("weight")), "tree")


def _depth(nodes: DataFrame) -> int:
    """Levels below the roots; the nodes are as many as the model that Spark holds on the driver."""
    return TreeArrays.of(nodes).depth()


def _visits(nodes: DataFrame, rows: DataFrame, features: list[str], keys: list[str]) -> list[DataFrame]:
    """Per level, the rows that are still on their way: (keys, tree, node, x) with the columns of the node."""
    numbers = [r["tree"] for r in nodes.select("tree").distinct().orderBy("tree").collect()]
    cells = F.array(*[F.col(c).cast("double") for c in features])
    starts = rows.select(*keys, cells.alias("x"), F.lit(0).alias("node"))
    here = starts.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in numbers]))).join(nodes, ["tree", "node"])
    levels = [here]
    for level in range(_depth(nodes)):
        goes = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        onward = here.filter("feature is not null").select(*keys, "x", "tree", goes.alias("node"))
        here = onward.join(nodes, ["tree", "node"])
        if level % LEVELS_A_PLAN == LEVELS_A_PLAN - 1:
            here = checkpointed(here)
        levels.append(here)
    return levels


def score_by_joins(nodes: DataFrame, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, prediction) from the node table alone: one join per level, then a weighted sum over the trees."""
    levels = _visits(nodes, rows, features, keys)
    leaves = levels[0].filter("feature is null")
    for level in levels[1:]:
        leaves = leaves.union(level.filter("feature is null"))
    return leaves.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("value")).alias("prediction"))


def split_checks(
    nodes: DataFrame, rows: DataFrame, features: list[str], target: str, key: str, boosted: bool = False, least: int = 1
) -> DataFrame:
    """(tree, best_split, means, sizes) from the rows that the trees were fitted on, all of them in every tree.

    ``best_split``: no threshold that the model uses anywhere would have left a smaller squared error at any node.
    ``means``: every node's value is the mean of its rows; ``sizes``: its row count is right, no child is under
    ``least``. Trees of a boosted chain are fitted to twice the residual of the trees before.
    """
    levels = _visits(nodes, rows, features, [key, target])
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    leaf = F.when(F.col("feature").isNull(), F.col("weight") * F.col("value"))
    label = F.col(target)
    if boosted:
        ended = every.groupBy(key, "tree").agg(F.sum(leaf).alias("part"), F.first(target).alias("y"))
        before = Window.partitionBy(key).orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)
        gone = F.sum("part").over(before)
        labels = ended.select(key, "tree", F.when(gone.isNull(), F.col("y")).otherwise(2 * (F.col("y") - gone)).alias("label"))
        every = every.join(labels, [key, "tree"])
    else:
        every = every.withColumn("label", label.cast("double"))
    every = checkpointed(every)

    # At most the model's own candidates: bins by features.
    used = nodes.filter("feature is not null").select("feature", "threshold").distinct().collect()
    steps = [sorted(r["threshold"] for r in used if r["feature"] == f) for f in range(len(features))]

    def bin_of(f: int) -> Column:
        above = [(F.get("x", F.lit(f)) > F.lit(t)).cast("int") for t in steps[f]]
        return F.struct(F.lit(f).alias("f"), sum(above, F.lit(0)).alias("bin"))

    bins = every.filter("feature is not null").select("tree", "node", "label", F.inline(F.array(*[bin_of(f) for f in range(len(features))])))
    sums = bins.groupBy("tree", "node", "f", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    whole = Window.partitionBy("tree", "node", "f")
    left = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.select(
        "tree", "node", F.sum("n").over(left).alias("nl"), F.sum("s").over(left).alias("sl"),
        F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"),
    ).filter(F.col("nl").between(F.lit(least), F.col("n") - least))
    rest = F.col("s") - F.col("sl")
    gain = F.coalesce(F.try_divide(F.col("sl") ** 2, F.col("nl")), F.lit(0.0)) + F.coalesce(
        F.try_divide(rest**2, F.col("n") - F.col("nl")), F.lit(0.0)
    )
    best = cut.groupBy("tree", "node").agg(F.max(gain).alias("best"))
    goes = F.get("x", F.col("feature")) <= F.col("threshold")
    own = every.filter("feature is not null").groupBy("tree", "node").agg(
        F.sum(goes.cast("int")).alias("nl"), F.sum(F.when(goes, F.col("label")).otherwise(0.0)).alias("sl"),
        F.count("*").alias("n"), F.sum("label").alias("s"),
    )
    chosen = own.select("tree", "node", gain.alias("chosen"), (F.least("nl", F.col("n") - F.col("nl")) >= least).alias("wide"))
    close = F.col("chosen") >= F.col("best") - 1e-9 * F.greatest(F.abs("best"), F.lit(1.0))
    splits = chosen.join(best, ["tree", "node"], "left").groupBy("tree").agg(
        F.min(F.coalesce(close, F.lit(False))).alias("best_split"), F.min("wide").alias("wide")
    )
    stats = every.groupBy("tree", "node").agg(
        F.avg("label").alias("mean"), F.count("*").alias("n"), F.first("value").alias("value"), F.first("rows").alias("rows")
    )
    true_to = stats.groupBy("tree").agg(
        F.min(F.abs(F.col("mean") - F.col("value")) < 1e-9).alias("means"), F.min(F.col("n") == F.col("rows")).alias("counts")
    )
    return true_to.join(splits, "tree", "left").select(
        "tree", F.coalesce("best_split", F.lit(True)).alias("best_split"), "means",
        (F.col("counts") & F.coalesce("wide", F.lit(True))).alias("sizes"),
    )


@dataclass(frozen=True)
class TreeArrays:
    """The nodes of a model in arrays, to score blocks of rows; as large as the model that Spark holds on the driver."""

    roots: np.ndarray
    weight: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, nodes: DataFrame) -> TreeArrays:
        found = nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        sizes = found.groupby("tree")["node"].size().to_numpy()
        roots = np.cumsum(sizes) - sizes
        base = np.repeat(roots, sizes)
        feature = found["feature"].fillna(-1).to_numpy(np.int64)
        return cls(
            roots,
            found["weight"].to_numpy(float)[roots],
            feature,
            found["threshold"].to_numpy(float),
            np.where(feature < 0, 0, base + found["left"].fillna(0).to_numpy(np.int64)),
            np.where(feature < 0, 0, base + found["right"].fillna(0).to_numpy(np.int64)),
            found["value"].to_numpy(float),
            found["rows"].to_numpy(np.int64),
        )

    def depth(self) -> int:
        """Steps from the roots to the deepest leaf."""
        at, steps = self.roots, 0
        while (at := at[self.feature[at] >= 0]).size:
            at, steps = np.concatenate([self.left[at], self.right[at]]), steps + 1
        return steps

    def cut_values(self, x: np.ndarray, depths: list[int | None], splits: list[int]) -> np.ndarray:
        """(len(depths), len(splits), rows, trees): each tree's value if it ends at a depth, and at nodes of fewer rows.

        A tree that was grown with all features at every split is cut, not grown again: what lies above the cut would
        be the same.
        """
        out = np.empty((len(depths), len(splits), len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for j, least in enumerate(splits):
            at, depth = np.tile(self.roots, (len(x), 1)), 0
            while True:
                for i, d in enumerate(depths):
                    if d == depth:
                        out[i, j] = self.value[at]
                going = (self.feature[at] >= 0) & (self.rows[at] >= least)
                if not going.any():
                    break
                feature = np.where(going, self.feature[at], 0)
                lower = x[rows, feature] <= self.threshold[at]
                at = np.where(going, np.where(lower, self.left[at], self.right[at]), at)
                depth += 1
            for i, d in enumerate(depths):
                if d is None or d > depth:
                    out[i, j] = self.value[at]
        return out


@dataclass(frozen=True)
class CutTrees:
    """A forest or chain that is scored from arrays, with its trees cut."""

    features: list[str]
    trees: TreeArrays
    depth: int | None = None
    least_split: int = 2

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 1024):
            part = self.trees.cut_values(x[at : at + 1024], [self.depth], [self.least_split])[0, 0]
            out[at : at + 1024] = part @ self.trees.weight
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        predict = self.predict

        @F.pandas_udf("double")
        def tree_predict(*cols: pd.Series) -> pd.Series:
            return pd.Series(predict(np.column_stack([c.to_numpy(float) for c in cols])))

        return df.withColumn("prediction", tree_predict(*self.features))


def cut_trees(model: Any, spark: SparkSession, average: bool, depth: int | None = None, least_split: int = 2) -> CutTrees:
    return CutTrees(model.features, TreeArrays.of(node_table(model, spark, average)), depth, least_split)
