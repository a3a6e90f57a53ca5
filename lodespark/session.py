"""Session helpers: local sessions for tests, shared scratch space, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most rows a side may have before it is no longer hinted for broadcast.
BROADCAST_ROWS = 20_000
# Rows worth a task of their own in an iterative fit.
PARTITION_ROWS = 20_000


def local_session(app: str = "lodespark", cores: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def inline_table(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """A small constant table as SQL ``VALUES``, which the optimizer sees as a local relation."""
    cells = ",".join("(" + ",".join(_literal(v) for v in row) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {cells}").toDF(*schema.names)
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is made only for local masters,
    where every task runs on this machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodespark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so later stages survive lost executors."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows; otherwise leave the join to shuffle."""
    small = len(df.select(F.lit(1)).limit(max_rows + 1).collect()) <= max_rows
    return F.broadcast(df) if small else df


def sized(df: DataFrame, rows_per_partition: int = PARTITION_ROWS) -> DataFrame:
    """Merge the partitions of a small table before an iterative fit.

    Such fits run hundreds of short jobs, each paying for every task; a large table keeps its partitions.
    """
    return df.coalesce(max(1, -(-df.count() // rows_per_partition)))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in fewer splits than there are cores.

    A single small file would otherwise keep one task busy. Inputs with enough splits pass untouched, so nothing
    is shuffled on large data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
