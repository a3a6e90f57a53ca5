"""What the operators share: tables, saved intermediates, the learning fold and packing of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.session import scratch_path

#: Characters that a task looks at together; longer texts are cut at white space and their parts summed.
PACK_CHARS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later stages start from the files, whatever is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of :func:`saved` tables that no later step reads."""
    for frame in frames:
        folders = {path.rsplit("/", 1)[0] for path in frame.inputFiles()}
        for folder in folders:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from; a null id is in neither fold and gives false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def unit_hash(*cols: Column, seed: str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def pieces(text: str, limit: int = PACK_CHARS) -> Iterator[str]:
    """Cut a text at blanks or line ends into parts of at most ``limit`` characters.

    A run of more than ``limit`` characters without either is cut where it must be.
    """
    start = 0
    while len(text) - start > limit:
        end = max(text.rfind(" ", start + 1, start + limit), text.rfind("\n", start + 1, start + limit))
        end = start + limit if end < 0 else end
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def packs(texts: list[str], limit: int = PACK_CHARS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Group texts, cut by :func:`pieces`, into packs of about ``limit`` characters: (row of each part, parts)."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        for part in pieces(text, limit):
            if held and held + len(part) > limit:
                yield np.array(rows), parts
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(part)
            held += len(part) + 2
    if rows:
        yield np.array(rows), parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the parts, each with a blank on both sides, and where each part's padded span starts."""
    joined = " " + "  ".join(parts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 2)])
    return codes, starts


def span_sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values``, which stand at the ascending positions ``at``, over the spans between ``starts``."""
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.searchsorted(at, starts)
    return total[edge[1:]] - total[edge[:-1]]
