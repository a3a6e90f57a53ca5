"""Rows as cached NumPy blocks for iterative trainers; each pass sums block results up a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.operators.metrics import RELATIVE_EPS
from lodespark.session import sized


def numeric_blocks(df: DataFrame, features: list[str], target: str) -> RDD:
    """Blocks of rows ``[features..., target]`` as arrays, cached with spilling; a block is one Arrow batch.

    A lost block is rebuilt from the rows. The caller unpersists.
    """
    columns = [*features, target]
    rows = sized(df).select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    def unpack(row) -> np.ndarray:
        return np.frombuffer(row[0], dtype=float).reshape(-1, len(columns))

    return rows.mapInArrow(pack, "block binary").rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def sum_over(blocks: RDD, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of one vector per block, combined in two levels rather than at the driver."""
    return blocks.treeAggregate(np.zeros(size), lambda acc, b: acc + fn(b), lambda a, b: a + b, depth=2)


def fold_sums(folds: DataFrame, features: list[str], target: str, models: dict[int, Any]) -> dict[int, dict[str, float]]:
    """The four metrics of each fold's model (``predict`` on arrays) on its rows, all in one pass: {fold: {metric: value}}."""
    outs = list(models)
    # Sums of squares around the overall mean do not cancel.
    middle = float(folds.agg(F.avg(target)).first()[0] or 0.0)

    def errors(block: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(outs), 6))
        for i, fold in enumerate(outs):
            rows = block[block[:, 0] == fold]
            if len(rows):
                y = rows[:, -1]
                e = y - models[fold].predict(rows[:, 1:-1])
                relative = np.abs(e) / (np.abs(y) + RELATIVE_EPS)
                off = y - middle
                sums[i] = [len(y), e @ e, np.abs(e).sum(), relative.sum(), off.sum(), off @ off]
        return sums.ravel()

    blocks = numeric_blocks(folds, ["fold", *features], target)
    try:
        total = sum_over(blocks, errors, 6 * len(outs)).reshape(len(outs), 6)
    finally:
        blocks.unpersist()
    found = {}
    for fold, (n, squares, size, relative, y, yy) in zip(outs, total.tolist()):
        if n:
            spread = yy - y * y / n
            r2 = 1 - squares / spread if spread > 0 else float(squares == 0)
            found[fold] = {"mse": squares / n, "mae": size / n, "mre": relative / n, "r2": r2}
    return found
