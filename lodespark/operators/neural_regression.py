"""Multi-layer perceptron regression, trained in mini-batches where the data lies.

Rows are dealt to chains by a hash of their values and stand in its order, so neither chains nor batches depend on
partitions. A chain holds about ``CHAIN_ROWS`` rows in one array. An epoch walks every chain in batches of ``BATCH`` rows,
shuffled by seed and epoch, with one Adam step per batch. A table of one chain is trained to the end inside a task. With
more chains, each walks from the same weights, and weights and moments are averaged, by rows, after the epoch: one
job per epoch, whatever the batches.

Any number of networks is trained at once: a slice of networks, bounded by its weights, takes its epochs in the same jobs,
each with its own stop.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.operators.blocks import numeric_blocks, sum_over

# Rows of a batch, and of a chain that is walked in order.
BATCH = 200
CHAIN_ROWS = 50_000
# Weights of the networks that are trained in the same jobs; more where there is one chain, and only weights go round.
SLICE_WEIGHTS, ONE_CHAIN_WEIGHTS = 500_000, 4_000_000
# Training stops after this many epochs in a row without an improvement by the tolerance.
PATIENCE = 10
TOLERANCE = 1e-4
VALIDATION_SHARE = 10


def layer_shapes(n_in: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [n_in, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def unpack(theta: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight matrices and biases as views of the flat parameter vector."""
    layers, at = [], 0
    for rows, cols in shapes:
        w = theta[at : at + rows * cols].reshape(rows, cols)
        layers.append((w, theta[at + rows * cols : at + (rows + 1) * cols]))
        at += (rows + 1) * cols
    return layers


def initial_weights(shapes: list[tuple[int, int]], activation: str, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for rows, cols in shapes:
        bound = np.sqrt((6.0 if activation == "relu" else 2.0) / (rows + cols))
        parts.append(rng.uniform(-bound, bound, (rows + 1) * cols))
    return np.concatenate(parts)


def forward(x: np.ndarray, layers: list, activation: str) -> list[np.ndarray]:
    """Outputs of all layers, input first."""
    outs = [x]
    for i, (w, b) in enumerate(layers):
        z = outs[-1] @ w + b
        if i < len(layers) - 1:
            z = np.maximum(z, 0.0) if activation == "relu" else np.tanh(z)
        outs.append(z)
    return outs


def loss_gradient(
    theta: np.ndarray, x: np.ndarray, y: np.ndarray, shapes: list, activation: str, alpha: float
) -> tuple[float, np.ndarray]:
    """Half the mean squared error plus the weight penalty per row, and its gradient."""
    layers = unpack(theta, shapes)
    outs = forward(x, layers, activation)
    n = len(y)
    error = outs[-1][:, 0] - y
    penalty = sum(float((w * w).sum()) for w, _ in layers)
    loss = float(error @ error) / (2 * n) + alpha * penalty / (2 * n)
    grads, delta = [], error[:, None] / n
    for i in range(len(layers) - 1, -1, -1):
        w = layers[i][0]
        grads.append(np.concatenate([(outs[i].T @ delta + alpha * w / n).ravel(), delta.sum(0)]))
        if i:
            slope = (outs[i] > 0).astype(float) if activation == "relu" else 1.0 - outs[i] ** 2
            delta = (delta @ w.T) * slope
    return loss, np.concatenate(grads[::-1])


@dataclass(frozen=True)
class NeuralModel:
    """Fitted network; inputs are raw features, centred and scaled inside."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    hidden: tuple[int, ...]
    activation: str
    theta: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        layers = unpack(self.theta, layer_shapes(x.shape[1], self.hidden))
        return forward((x - self.mean) / self.scale, layers, self.activation)[-1][:, 0]

    def transform(self, df: DataFrame) -> DataFrame:
        predict = self.predict

        @F.pandas_udf("double")
        def neural_predict(*cols: pd.Series) -> pd.Series:
            return pd.Series(predict(np.column_stack([c.to_numpy(float) for c in cols])))

        return df.withColumn("prediction", neural_predict(*self.features))


@dataclass
class _Run:
    """A network in training: its settings, what it leaves out, and where it stands."""

    left_out: int
    shapes: list[tuple[int, int]]
    activation: str
    alpha: float
    rate: float
    epochs: int
    early: bool
    seed: int
    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    batch: int
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    steps: int = 0
    done: int = 0
    best: float = np.inf
    stalled: int = 0
    best_theta: np.ndarray | None = None

    @property
    def running(self) -> bool:
        return self.done < self.epochs and self.stalled < PATIENCE

    def walk(self, x: np.ndarray, y: np.ndarray, chain: int) -> float:
        """One epoch over a chain; the sum of the losses of its rows."""
        order = np.random.default_rng([self.seed, chain, self.done]).permutation(len(y))
        total = 0.0
        if self.m is None:
            self.m, self.v = np.zeros(len(self.theta)), np.zeros(len(self.theta))
        for at in range(0, len(y), self.batch):
            rows = order[at : at + self.batch]
            loss, g = loss_gradient(self.theta, x[rows], y[rows], self.shapes, self.activation, self.alpha)
            total += loss * len(rows)
            self.steps += 1
            self.m = 0.9 * self.m + 0.1 * g
            self.v = 0.999 * self.v + 0.001 * g * g
            rate = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            self.theta = self.theta - rate * self.m / (np.sqrt(self.v) + 1e-8)
        return total

    def told(self, losses: float, rows: float, checks: np.ndarray) -> None:
        """Take the outcome of an epoch: the training loss, or the explained share on the checked rows."""
        self.done += 1
        score = losses / max(rows, 1.0)
        n, wrong, total, squares = checks
        if self.early and n:
            spread = squares - total * total / n
            score = wrong / spread if spread > 0 else wrong
        self.stalled = 0 if score < self.best - TOLERANCE else self.stalled + 1
        if score < self.best:
            self.best, self.best_theta = score, self.theta

    def checked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(rows, squared errors, sum, sum of squares) of checked rows."""
        error = forward(x, unpack(self.theta, self.shapes), self.activation)[-1][:, 0] - y
        return np.array([len(y), error @ error, y.sum(), y @ y])


def _split(run: _Run, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training and checked rows of a chain [fold, check, features..., target] for a run."""
    rows = block[block[:, 0] != run.left_out]
    check = (rows[:, 1] > 0) if run.early else np.zeros(len(rows), dtype=bool)
    x, y = (rows[:, 2:-1] - run.mean) / run.scale, rows[:, -1]
    return x[~check], y[~check], x[check], y[check]


def _chains(rows: DataFrame, features: list[str], target: str) -> RDD:
    """Chains (number, rows as an array [fold, check, features..., target] in hash order), cached with spilling.

    Equal rows are counted first and told apart by their number, so that they are spread over the chains.
    """
    cells = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])]
    names = [f"c{i}" for i in range(len(cells))]
    counted = rows.select(F.col("_fold").cast("double").alias("fold"), *cells).groupBy("fold", *names).agg(F.count("*").alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    order = F.xxhash64(*names, "copy")
    total = counted.agg(F.sum("n")).first()[0] or 0
    chains = max(1, -(-total // CHAIN_ROWS))
    check = (F.pmod(F.xxhash64(F.lit("check"), *names, "copy"), F.lit(VALIDATION_SHARE)) == 0).cast("double")
    dealt = each.select(F.pmod(order, F.lit(chains)).alias("chain"), order.alias("at"), "fold", check.alias("check"), *names)
    columns = ["fold", "check", *names]

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        at = [(c, "ascending") for c in ("at", *names, "fold")]
        block = np.column_stack([c.to_numpy() for c in group.sort_by(at).select(columns).columns])
        return pa.table({"chain": [key[0].as_py()], "block": pa.array([block.tobytes()], pa.binary())})

    packed = dealt.groupBy("chain").applyInArrow(pack, "chain long, block binary").rdd
    return packed.map(lambda r: (r[0], np.frombuffer(r[1]).reshape(-1, len(columns)))).persist(StorageLevel.MEMORY_AND_DISK)


def _train(chains: RDD, count: int, runs: list[_Run]) -> list[_Run]:
    """Train a slice of networks until each has stopped."""
    if not count:
        return runs
    if count == 1:
        # The one chain is copied to tasks of a few networks each, which train them to the end.
        parts = min(len(runs), 4 * chains.context.defaultParallelism)

        def whole(place: int, chain: tuple[int, np.ndarray]) -> list[tuple[int, _Run]]:
            out = []
            for i in range(place, len(runs), parts):
                run = replace(runs[i])
                x, y, xc, yc = _split(run, chain[1])
                while run.running and len(y):
                    losses = run.walk(x, y, chain[0])
                    run.told(losses, len(y), run.checked(xc, yc))
                out.append((i, replace(run, m=None, v=None)))
            return out

        copies = chains.flatMap(lambda chain: [(i, chain) for i in range(parts)]).partitionBy(parts, lambda i: i)
        return [run for _, run in sorted(copies.flatMap(lambda kv: whole(*kv)).collect(), key=lambda found: found[0])]
    while any(r.running for r in runs):
        going = [r for r in runs if r.running]

        def epoch(chain: tuple[int, np.ndarray], going: list[_Run] = going) -> list[np.ndarray]:
            out = []
            for run in going:
                x, y, xc, yc = _split(run, chain[1])
                mine = replace(run)
                losses = mine.walk(x, y, chain[0])
                sums = np.concatenate([mine.theta, mine.m, mine.v, [mine.steps]]) * len(y)
                out.append(np.concatenate([sums, [losses, len(y)], np.zeros(4)]))
            return out

        sums = chains.map(epoch).treeReduce(lambda a, b: [x + y for x, y in zip(a, b)], depth=2)
        for run, total in zip(going, sums):
            size, n = len(run.theta), max(total[-5], 1.0)
            run.theta, run.m, run.v = (total[i * size : (i + 1) * size] / n for i in range(3))
            run.steps = round(total[3 * size] / n)
        checks = [np.zeros(4)] * len(going)
        if any(r.early for r in going):
            checks = chains.map(lambda c, going=going: [r.checked(*_split(r, c[1])[2:]) for r in going]).treeReduce(
                lambda a, b: [x + y for x, y in zip(a, b)], depth=2
            )
        for run, total, check in zip(going, sums, checks):
            run.told(total[-6], total[-5], check)
    return runs


def fit_networks(
    folds: DataFrame,
    features: list[str],
    target: str,
    settings: list[dict],
    outs: list[int],
    seed: int = 0,
    standardise: bool = True,
) -> list[list[NeuralModel]]:
    """Networks of every setting on the rows outside every fold of ``outs``, column ``_fold``: a list per fold."""
    p = len(features)
    squares = [F.sum(F.col(c) * F.col(c)) for c in features]
    sums = folds.groupBy("_fold").agg(F.count(F.lit(1)), F.sum(target), *[F.sum(c) for c in features], *squares)
    stats = {r[0]: np.array(r[1:], float) for r in sums.collect()}
    runs = []
    for left_out in outs:
        n, total, *cells = sum((v for f, v in stats.items() if f != left_out), np.zeros(2 * p + 2))
        n = max(n, 1.0)
        mean, scale = np.zeros(p), np.ones(p)
        if standardise:
            mean = np.array(cells[:p]) / n
            scale = np.sqrt(np.maximum(np.array(cells[p:]) / n - mean**2, 0.0))
            scale[~(scale > 1e-12 * np.maximum(np.abs(mean), 1.0))] = 1.0
        for s in settings:
            shapes = layer_shapes(p, tuple(s.get("hidden_layer_sizes", (100,))))
            theta = initial_weights(shapes, s.get("activation", "relu"), seed)
            theta[-1] = total / n
            runs.append(
                _Run(
                    left_out, shapes, s.get("activation", "relu"), s.get("alpha", 1e-4), s.get("learning_rate_init", 1e-3),
                    s.get("max_iter", 1000), s.get("early_stopping", False), seed, mean, scale, theta, BATCH,
                )
            )
    chains = _chains(folds, features, target)
    trained: list[_Run] = []
    try:
        count, at = chains.count(), 0
        limit = ONE_CHAIN_WEIGHTS if count == 1 else SLICE_WEIGHTS
        while at < len(runs):
            end, held = at, 0
            while end < len(runs) and (end == at or held + len(runs[end].theta) <= limit):
                held += len(runs[end].theta)
                end += 1
            trained += _train(chains, count, runs[at:end])
            at = end
    finally:
        chains.unpersist()
    models = [
        NeuralModel(features, r.mean, r.scale, tuple(cols for _, cols in r.shapes[:-1]), r.activation, r.theta if r.best_theta is None else r.best_theta)
        for r in trained
    ]
    return [models[i : i + len(settings)] for i in range(0, len(models), len(settings))]


def fit_neural(
    df: DataFrame, features: list[str], target: str, seed: int = 0, standardise: bool = True, **setting
) -> NeuralModel:
    """One network on all rows: ``hidden_layer_sizes``, ``activation``, ``alpha``, ``learning_rate_init``, ``max_iter`` epochs.

    ``early_stopping`` watches a tenth of the rows, picked by hash, instead of the training loss.
    """
    rows = df.select(*features, target).withColumn("_fold", F.lit(0))
    return fit_networks(rows, features, target, [setting], [-1], seed, standardise)[0][0]


def neural_cv_errors(
    folds: DataFrame, features: list[str], target: str, settings: list[dict], k: int, seed: int = 0
) -> list[list[float]]:
    """Mean squared error of every setting on every fold (1..k), fitted on the others; one pass scores all."""
    rows = folds.withColumn("_fold", F.col("fold"))
    models = fit_networks(rows, features, target, settings, list(range(1, k + 1)), seed)

    def squares(block: np.ndarray) -> np.ndarray:
        out = np.zeros((k, len(settings) + 1))
        for f in range(k):
            mine = block[block[:, 0] == f + 1]
            out[f] = [*[((m.predict(mine[:, 1:-1]) - mine[:, -1]) ** 2).sum() for m in models[f]], len(mine)]
        return out.ravel()

    blocks = numeric_blocks(rows, ["_fold", *features], target)
    try:
        total = sum_over(blocks, squares, k * (len(settings) + 1)).reshape(k, -1)
    finally:
        blocks.unpersist()
    return (total[:, :-1] / np.maximum(total[:, -1:], 1)).T.tolist()
