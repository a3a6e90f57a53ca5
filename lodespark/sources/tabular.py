"""Tabular sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodespark.operators.features import FEATURES

EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("composition", T.StringType()),
        T.StructField("total_magnetization_normalized_vol", T.StringType()),
        T.StructField("is_magnetic", T.BooleanType()),
    ]
)


def feature_schema(formula: str = "formula", target: str = "ms") -> T.StructType:
    """Schema of a stored feature table."""
    return T.StructType(
        [T.StructField(formula, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in [target, *FEATURES]]]
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read a table under a declared schema; columns are matched by name.

    A CSV file may hold more columns than the schema and in another order, so its header is read for the names
    and everything not asked for is pruned by the reader.
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    names = spark.read.option("header", True).csv(path).columns
    declared = {f.name: f.dataType for f in schema}
    full = T.StructType([T.StructField(n, declared.get(n, T.StringType())) for n in names])
    return spark.read.schema(full).option("header", True).csv(path).select(*schema.names)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table in parallel part files."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
