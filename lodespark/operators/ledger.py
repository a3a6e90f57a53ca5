"""A ledger of finished work: small result rows appended as Parquet, so that a run that was stopped goes on."""

from __future__ import annotations

from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodespark.session import inline_table


class Ledger:
    """Result rows of one kind of work at ``path``, kept in memory only if there is no path.

    A row is appended when its work is done, by one writer at a time; one write is one file, which is there in whole or
    not at all. Rows number the fits of a run, not its data.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, path: str | None = None):
        self.spark, self.schema, self.path = spark, schema, path
        self._rows: list[tuple] = []
        self._one_writer = Lock()

    def table(self) -> DataFrame:
        """All rows so far."""
        if self.path is None:
            return inline_table(self.spark, self.schema, self._rows) if self._rows else self.spark.createDataFrame([], self.schema)
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def left(self, planned: list[tuple], keys: list[str]) -> list[tuple]:
        """The planned work, by its keys, that has no row yet."""
        if not planned:
            return []
        schema = T.StructType([self.schema[k] for k in keys])
        done = self.table().select(*keys).distinct()
        rest = {tuple(r) for r in inline_table(self.spark, schema, planned).join(done, keys, "left_anti").collect()}
        return [p for p in planned if p in rest]

    def add(self, rows: list[tuple]) -> None:
        with self._one_writer:
            if self.path is None:
                self._rows += rows
            elif rows:
                inline_table(self.spark, self.schema, rows).coalesce(1).write.mode("append").parquet(self.path)
