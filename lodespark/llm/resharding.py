"""Minimum-cost-flow resharding: reach new shard sizes by moving the fewest bytes.

Old shards supply their bytes, new shards take their capacity; a byte that stays in its shard costs nothing, one that
moves costs one. The flow of least cost says how many bytes go from each old to each new shard. An old shard's rows are
put in the order of a hash, and its bytes are cut in that order: first what stays, then a block for each receiver. Only
shards that give or take a block are written anew.

The driver sees one size per shard and one cut per flow, at most old plus new shards. No task sees a whole shard:
hash keys are even, so ranges of them are even buckets, in which sizes and places are summed up. Texts are shuffled
once, straight to (shard, bucket).

Rows that agree in old shard, id and text have one hash key. Where they are more than a small part of a shard, they are
numbered among themselves and the number goes into the key, so they spread over ranges and shards like other rows.

Defined cases: a null text has no bytes; a null id sorts first; few rows that agree in id and text are one block and stay
together, many are interchangeable and dealt one by one; a row whose middle lies before a cut is in front of it; an empty
table gives empty shards; columns named as the result's shard and slot are replaced, other extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodespark.llm.common import saved
from lodespark.session import bounded_broadcast, inline_table, scratch_path

SHARDS = 40
#: Bytes that a row costs beside its text.
ROW_BYTES = 16
BUCKET_BYTES = 2 << 20
#: Equal rows stay together up to this part of a shard and so many buckets, whichever is less.
TIE_PART, TIE_BUCKETS = 64, 4
SAME = ["__old", "__id", "__crc"]

LOWEST = -(1 << 63)
CUT_SCHEMA = T.StructType(
    [T.StructField("__old", T.IntegerType()), T.StructField("__shard", T.IntegerType())]
    + [T.StructField(f"__{side}_{c}", T.LongType()) for side in ("lo", "hi") for c in ("key", "id", "crc")]
)


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> dict[tuple[int, int], int]:
    """Flow of least cost from suppliers to takers, by successive shortest paths: {(supplier, taker): amount}.

    ``cost[i, j]`` is what one unit from i to j costs. The capacities must hold all supplies.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supplies")
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    for source in range(n):
        while left[source]:
            # Bellman-Ford: from suppliers to takers at cost, back along flow at minus cost.
            far = np.full(n, np.inf)
            far[source] = 0
            came: dict[int, tuple[int, int]] = {}
            while True:
                reach = far[:, None] + cost
                via, near = reach.argmin(axis=0), reach.min(axis=0)
                better = [
                    (i, j) for (i, j), f in flow.items() if f and near[j] - cost[i, j] < far[i] - 1e-9
                ]
                if not better:
                    break
                for i, j in better:
                    if near[j] - cost[i, j] < far[i] - 1e-9:
                        far[i] = near[j] - cost[i, j]
                        came[i] = (int(via[j]), j)
            end = min((j for j in range(m) if room[j]), key=lambda j: (near[j], j))
            path = [(int(via[end]), end)]
            while path[-1][0] != source:
                path.append(came[path[-1][0]])
            # Forward along (i, j); what supplier i then gives less goes back along its own later entry.
            back = [(path[k][0], path[k + 1][1]) for k in range(len(path) - 1)]
            amount = min([left[source], room[end], *(flow[edge] for edge in back)])
            for edge in path:
                flow[edge] = flow.get(edge, 0) + amount
            for edge in back:
                flow[edge] -= amount
            left[source] -= amount
            room[end] -= amount
    return {edge: f for edge, f in sorted(flow.items()) if f}


def moving_cost(old: int, new: int) -> np.ndarray:
    return 1.0 - np.eye(old, new)


@dataclass
class Plan:
    """``flows``: bytes from old to new shards; ``cuts``: after which row each block of an old shard ends; ``ties``: old
    shard, id and text of the rows that are numbered."""

    flows: dict[tuple[int, int], int]
    cuts: DataFrame
    offsets: DataFrame
    ties: DataFrame
    buckets: int
    shards: int

    @property
    def affected(self) -> list[int]:
        return sorted({s for i, j in self.flows if i != j for s in (i, j) if s < self.shards})


def _keys(docs: DataFrame, old_shard: Column) -> DataFrame:
    """``docs`` with what decides a row's place: old shard, hash key, id, checksum and size."""
    crc = text_crc32(F.col("text"))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    return docs.withColumns(
        {
            "__old": old_shard.cast("int"),
            "__key": F.shiftrightunsigned(F.xxhash64(F.lit("reshard"), doc_id, crc), 1),
            "__id": doc_id,
            "__crc": crc,
            "__size": row_size(F.col("text")),
        }
    )


def _ties(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """(old shard, id, checksum) that many rows share; there are at most ``TIE_PART * shards`` or one per few buckets."""
    most = min(total // (TIE_PART * shards), TIE_BUCKETS * BUCKET_BYTES)
    shared = rows.groupBy(*SAME).agg(F.count("*").alias("n"), F.sum("__size").alias("bytes"))
    return saved(shared.filter((F.col("n") > 1) & (F.col("bytes") > most)).select(*SAME), "reshard-ties")


def _numbered(rows: DataFrame, ties: DataFrame) -> DataFrame:
    """``rows`` of :func:`_keys`, those of a tie with their number among themselves in the key.

    Tied rows are saved with the task that wrote them and their place in it, so numbers do not change when a task is run
    again, and no task numbers more rows than one wrote.
    """
    if ties.isEmpty():
        return rows
    few = bounded_broadcast(ties)
    place = F.monotonically_increasing_id()
    tied = saved(rows.join(few, SAME, "left_semi").withColumn("__place", place), "reshard-tied")
    tied = tied.withColumn("__task", F.shiftright("__place", 33))
    in_front = Window.partitionBy(*SAME).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tied.groupBy(*SAME, "__task").agg(F.count("*").alias("__rows"))
    tasks = tasks.select(*SAME, "__task", F.coalesce(F.sum("__rows").over(in_front), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*SAME, "__task").orderBy("__place")
    numbered = tied.withColumn("__at", F.row_number().over(inside)).join(tasks, [*SAME, "__task"])
    number = F.col("__ahead") + F.col("__at")
    key = F.shiftrightunsigned(F.xxhash64(F.lit("reshard"), "__id", "__crc", number), 1)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    alone = rows.join(few, SAME, "left_anti").select(*columns)
    return alone.union(numbered.withColumn("__key", key).select(*columns))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    top = F.shiftright("__key", 31)
    return rows.withColumn("__bucket", F.shiftright(top * F.lit(buckets).cast("long"), 32))


def _placed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with their new shard. There are at most as many cuts as old and new shards."""
    here, low, high = (
        F.struct(*[F.col(f"__{side}{c}").alias(c) for c in ("key", "id", "crc")]) for side in ("", "lo_", "hi_")
    )
    inside = (rows.__old == cuts.__cut_old) & (here > low) & (here <= high)
    return rows.join(F.broadcast(cuts), inside).drop(*[c for c in cuts.columns if c != "__shard"])


def plan_reshard(
    docs: DataFrame, old_shard: Column, shards: int = SHARDS, capacities: list[int] | None = None
) -> Plan:
    """Solve the flow for ``docs`` (doc_id, text and what ``old_shard`` needs), whose old shards count from 0."""
    spark = docs.sparkSession
    rows = saved(_keys(docs, old_shard).select("__old", "__key", "__id", "__crc", "__size"), "reshard-keys")
    sizes = {r["__old"]: r["bytes"] for r in rows.groupBy("__old").agg(F.sum("__size").alias("bytes")).collect()}
    supply = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    total = sum(supply)
    flows = min_cost_flow(supply, capacities or even_capacities(total, shards), moving_cost(len(supply), shards))
    buckets = max(1, -(-total // BUCKET_BYTES))
    ties = _ties(rows, total, shards)

    rows = _bucketed(_numbered(rows, ties), buckets)
    in_front = Window.partitionBy("__old").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__old", "__bucket").agg(F.sum("__size").alias("__bytes"))
    before = before.select(
        "__old", "__bucket", F.coalesce(F.sum("__bytes").over(in_front), F.lit(0)).alias("__before")
    )
    inside = (
        Window.partitionBy("__old", "__bucket")
        .orderBy("__key", "__id", "__crc")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    middle = 2 * (F.col("__before") + F.col("__sum")) + F.col("__size")
    middles = (
        rows.withColumn("__sum", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
        .join(before, ["__old", "__bucket"])
        .withColumn("__middle", middle)
    )

    blocks = []
    for i in range(len(supply)):
        own = sorted((j for a, j in flows if a == i), key=lambda j: (j != i, j))
        lo = 0
        for j in own:
            blocks.append((i, j, 2 * lo, 2 * (lo + flows[i, j])))
            lo += flows[i, j]
    schema = T.StructType(
        [T.StructField("__cut_old", T.IntegerType()), T.StructField("__shard", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("__lo", "__hi")]
    )
    ranges = inline_table(spark, schema, blocks or [(-1, 0, 0, 0)])
    within = (F.col("__old") == F.col("__cut_old")) & (F.col("__middle") >= F.col("__lo")) & (F.col("__middle") < F.col("__hi"))
    lasts = {
        (r["__old"], r["__shard"]): tuple(r["last"])
        for r in middles.join(F.broadcast(ranges), within)
        .groupBy("__old", "__shard")
        .agg(F.max(F.struct("__key", "__id", "__crc")).alias("last"))
        .collect()
    }
    cuts, lowest = [], (LOWEST, LOWEST, LOWEST)
    for i in range(len(supply)):
        filled = [(j, lasts[i, j]) for a, j, *_ in blocks if a == i and (i, j) in lasts]
        low = lowest
        for j, last in filled:
            if last > low:
                cuts.append((i, j, *low, *last))
                low = last
    names = ["__cut_old", *CUT_SCHEMA.names[1:]]
    cut_rows = inline_table(spark, CUT_SCHEMA, cuts or [(-1, 0, *lowest, *lowest)]).toDF(*names)

    groups = _placed(rows, cut_rows).groupBy("__shard", "__old", "__bucket").agg(F.count("*").alias("__rows"))
    ahead = Window.partitionBy("__shard").orderBy("__old", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        "__shard", "__old", "__bucket", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__offset")
    )
    return Plan(flows, cut_rows, saved(offsets, "reshard-offsets"), ties, buckets, shards)


def place(docs: DataFrame, old_shard: Column, plan: Plan) -> DataFrame:
    """``docs`` with shard and slot of each row."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = _placed(_bucketed(_numbered(_keys(docs, old_shard), plan.ties), plan.buckets), plan.cuts)
    inside = Window.partitionBy("__shard", "__old", "__bucket").orderBy("__key", "__id", "__crc")
    slot = F.col("__offset") + F.row_number().over(inside) - 1
    return rows.join(plan.offsets, ["__shard", "__old", "__bucket"]).select(
        *[F.col(f"`{c}`") for c in kept], F.col("__shard").alias("shard"), slot.cast("long").alias("slot")
    )


def reshard(
    docs: DataFrame,
    old_shard: Column,
    path: str | None = None,
    shards: int = SHARDS,
    capacities: list[int] | None = None,
) -> DataFrame:
    """Rewrite the affected shards as Parquet under ``path``, one folder each, and give all rows with shard and slot.

    Rows of shards that neither give nor take a block are read where they were.
    """
    plan = plan_reshard(docs, old_shard, shards, capacities)
    placed = place(docs, old_shard, plan)
    affected = plan.affected
    path = path or scratch_path(docs.sparkSession, "shards")
    moved = placed.filter(F.col("shard").isin(affected))
    moved.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.schema(placed.schema).parquet(path).select(*placed.columns)
    if len(affected) >= shards:
        return written
    return written.union(placed.filter(~F.col("shard").isin(affected)))
