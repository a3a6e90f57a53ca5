"""Approximate nearest neighbours from shifted space-filling curves.

Vectors are projected by ``CURVES`` random rotations to a few dimensions, each dimension scaled by the quantiles of a
sample, shifted, and put in Hilbert order. Each order is partitioned into ranges whose ends come from the sample. Scaled
so, a dense cluster is spread over many cells and a far outlier is only the last one, so ranges are even in either case.
A query is compared with its own range and those beside it, on the vectors less the fitted centre in double precision;
the best of all windows merge, and are reranked with the exact distance of the original vectors.

The window is a part of all vectors: at least ``WINDOW / sqrt(n)``, and as much as it takes for queries of the sample to
find ``RECALL`` of their nearest in the sample. Among all vectors the nearest are nearer still, so they are found at least
as often. Ranges hold at most about ``RANGE_ROWS`` vectors; a window that is wider takes more ranges on either side.

Equal vectors are indexed once and expanded at the end, each to its smallest ids, so a vector that many rows share is
no hot range, and ties go to smaller ids. The index is fitted on at most about ``SAMPLE`` vectors, but holds them all.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another length than most take
no part, and neither do rows without id; rows that repeat an id are one candidate, with the smallest of their vectors
that take part; fewer candidates than ``k`` give fewer rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodespark.llm.common import saved, unit_hash

CURVES = 32
#: Dimensions and bits of each that a curve runs through.
PROJECTED = 8
BITS = 8
#: Quantiles that scale a dimension, and the part of it that curves are shifted by.
LEVELS, SHIFTED = 257, 0.125
#: Least vectors of a window on either side, as a multiple of the square root of all vectors.
WINDOW = 2.0
#: Part of the nearest that the windows find in the sample, and the sample's queries that tell.
RECALL, PROBES = 0.95, 500
RANGE_ROWS = 20_000
#: Distances that a task holds at once.
BLOCK = 1 << 22
#: Most vectors, as expected number, that range ends and scales are fitted on.
SAMPLE = 40_000
#: Of each range, and then of all, so many times k candidates go on.
KEPT_EACH, KEPT = 2, 4
SEED = 5

INDEX_SCHEMA = "curve int, range int, id long, rest binary"
CANDIDATE_SCHEMA = "query_id long, id long, near double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells``, whose values have ``bits`` bits."""
    x = cells.T.astype(np.uint64).copy()
    one, dims = np.uint64(1), len(x)
    top = np.uint64(1 << (bits - 1))
    level = top
    while level > one:
        below = level - one
        for i in range(dims):
            high = (x[i] & level) != 0
            swap = (x[0] ^ x[i]) & below
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        level >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = top
    while level > one:
        turn = np.where((x[-1] & level) != 0, turn ^ (level - one), turn)
        level >>= one
    x ^= turn
    key = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key


@dataclass
class Curves:
    """Rotations, centre, quantiles and shifts of the curves, the ends of their ranges, and how many of them a window
    takes on either side."""

    rotations: list[np.ndarray]
    centre: np.ndarray
    levels: list[np.ndarray]
    shifts: list[np.ndarray]
    ends: list[np.ndarray]
    beside: int = 1

    def key(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        flat = (vectors - self.centre) @ self.rotations[curve]
        even = np.linspace(0, 1, LEVELS)
        place = np.column_stack([np.interp(x, at, even) for x, at in zip(flat.T, self.levels[curve].T)])
        cells = (place * (1 - SHIFTED) + self.shifts[curve]) * (1 << BITS)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)

    def ranges(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.ends[curve], self.key(vectors, curve), "right")


def window_part(sample: np.ndarray, keys: list[np.ndarray], least: float, k: int, recall: float) -> float:
    """Part of all vectors that a range must hold, so that own and adjacent ranges find ``recall`` of the ``k`` nearest
    in the sample; ``least`` or more."""
    n = len(sample)
    k = min(k, n - 1)
    if k < 1 or 3 * least >= 1:
        return min(1.0, least)
    probes = np.random.default_rng(SEED).choice(n, min(n, PROBES), replace=False)
    sizes = (sample * sample).sum(axis=1)
    nearest = np.empty((len(probes), k), int)
    for i, probe in enumerate(probes):
        far = sizes - 2 * (sample @ sample[probe])
        far[probe] = np.inf
        nearest[i] = np.argpartition(far, k - 1)[:k]
    places = [np.argsort(np.argsort(own, kind="stable"), kind="stable") for own in keys]
    part = least
    while 3 * part < 1:
        found = np.zeros(nearest.shape, bool)
        for place in places:
            at = (place / (part * n)).astype(int)
            found |= np.abs(at[nearest] - at[probes][:, None]) <= 1
        if found.mean() >= recall:
            break
        part *= 1.15
    return min(1.0, part)


def fit(
    sample: np.ndarray, n: int, curves: int = CURVES, window: float | None = None, k: int = 10, recall: float = RECALL
) -> Curves:
    """Curves for ``n`` vectors of which ``sample`` are some; ``window`` times the root of n fixes the window."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    flat = min(PROJECTED, dim)
    model = Curves([], sample.mean(axis=0), [], [], [])
    keys = []
    for curve in range(curves):
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :flat]
        model.rotations.append(rotation)
        model.levels.append(np.quantile((sample - model.centre) @ rotation, np.linspace(0, 1, LEVELS), axis=0))
        model.shifts.append(rng.uniform(0, SHIFTED, flat))
        keys.append(model.key(sample, curve))
    least = (WINDOW if window is None else window) / n**0.5
    part = least if window is not None else window_part(sample, keys, least, k, recall)
    size = max(1.0, min(part * n, RANGE_ROWS))
    model.beside = max(1, -int(-part * n // size))
    ranges = max(1, round(n / size))
    for own in keys:
        cuts = np.sort(own)[(np.arange(1, ranges) * len(own)) // ranges]
        model.ends.append(np.unique(cuts))
    return model


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, in double precision."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).filter("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return rows
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.filter(
        (F.size("vector") == common["n"]) & finite & F.exists("vector", lambda x: x != 0)
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their doubles; minus zero is zero."""
    for batch in batches:
        raw = [(np.asarray(v, dtype="<f8") + 0.0).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "packed"])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    window: float | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose ``id`` meets ``is_query``, its own left out.

    ``score`` is the Euclidean distance of the original vectors.
    """
    spark = vectors.sparkSession
    found_schema = "query_id long, rank int, vec_id long, score double"
    full = usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = saved(full.mapInArrow(_packed, "id long, packed binary"), "vectors")
    copy = F.row_number().over(Window.partitionBy("packed").orderBy("id"))
    copies = saved(
        rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1)
        .withColumn("rep", F.min("id").over(Window.partitionBy("packed"))),
        "vector-copies",
    )
    distinct = copies.filter("copy = 1").select("id", "packed")
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], found_schema)
    sample = distinct.filter(unit_hash(F.col("id"), seed="curves") < min(1.0, SAMPLE / n)).select("id", "packed")
    taken = sample.toArrow() if n > 1 else distinct.toArrow()
    taken = taken if taken.num_rows else distinct.limit(1).toArrow()
    dim = len(taken.column(1)[0].as_py()) // 8
    matrix = _matrix(taken.sort_by("id").column(1), dim)
    fitted = fit(matrix, n, curves, window, k)
    shipped = spark.sparkContext.broadcast(fitted)

    def index(beside: int):
        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shipped.value
            for batch in batches:
                own = _matrix(batch.column(1), dim)
                if not len(own):
                    continue
                rest = pa.array([v.tobytes() for v in own - model.centre], pa.binary())
                for curve in range(len(model.ends)):
                    at = model.ranges(own, curve)
                    for step in range(-beside, beside + 1):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), curve, np.int32)),
                                pa.array((at + step).astype(np.int32)),
                                batch.column(0),
                                rest,
                            ],
                            names=["curve", "range", "id", "rest"],
                        )

        return rows_of

    queries = rows.filter(is_query)
    keep = KEPT_EACH * k

    def compare(base: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.Table.from_pylist([], pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("near", pa.float64())]))
        if not base.num_rows or not asked.num_rows:
            return empty

        def restored(table: pa.Table) -> np.ndarray:
            return _matrix(table.column("rest"), dim)

        b, ids = restored(base), base.column("id").to_numpy()
        # Small numbers keep their differences: the range's own mean is taken off both sides.
        middle = b.mean(axis=0)
        b = b - middle
        b_size = (b * b).sum(axis=1)
        out = []
        block = max(1, BLOCK // base.num_rows)
        for start in range(0, asked.num_rows, block):
            some = asked.slice(start, block)
            q = restored(some) - middle
            far = b_size[None, :] - 2 * (q @ b.T) + (q * q).sum(axis=1)[:, None]
            best = np.argpartition(far, keep, axis=1)[:, :keep] if far.shape[1] > keep else np.tile(
                np.arange(far.shape[1]), (len(q), 1)
            )
            out.append(
                pa.table(
                    {
                        "query_id": np.repeat(some.column("id").to_numpy(), best.shape[1]),
                        "id": ids[best.ravel()],
                        "near": np.take_along_axis(far, best, axis=1).ravel(),
                    }
                )
            )
        return pa.concat_tables(out)

    base = distinct.mapInArrow(index(0), INDEX_SCHEMA).groupBy("curve", "range")
    asked = queries.mapInArrow(index(fitted.beside), INDEX_SCHEMA).groupBy("curve", "range")
    merged = base.cogroup(asked).applyInArrow(compare, CANDIDATE_SCHEMA).groupBy("query_id", "id").agg(
        F.min("near").alias("near")
    )
    by_near = Window.partitionBy("query_id").orderBy("near", "id")
    best = merged.withColumn("place", F.row_number().over(by_near)).filter(F.col("place") <= KEPT * k)

    distance = F.sqrt(
        F.aggregate(
            F.zip_with("asked", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
        )
    )
    scored = (
        best.join(full, "id")
        .join(full.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
        .select("query_id", F.col("id").alias("rep"), distance.alias("score"))
    )
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        scored.join(copies.select("rep", F.col("id").alias("vec_id")), "rep")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
