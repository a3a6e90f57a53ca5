"""Element and pair-enthalpy dimensions: built-in sample tables, loaders and the symmetriser."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.session import inline_table

ELEMENT_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("electronegativity", T.StringType()),
        T.StructField("atomic_weight", T.DoubleType()),
        T.StructField("group_block", T.StringType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("melting_point", T.DoubleType()),
        T.StructField("valence", T.IntegerType()),
    ]
)
PAIR_SCHEMA = T.StructType(
    [T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("h", T.DoubleType())]
)

# Rounded general-knowledge element properties for tests and samples.
SAMPLE_ELEMENTS = [
    ("Fe", "1.83", 55.845, "Group 8", 4, 1811.0, 8),
    ("Co", "1.88", 58.933, "Group 9", 4, 1768.0, 9),
    ("Mn", "1.55", 54.938, "Group 7", 4, 1519.0, 7),
    ("Cr", "1.66", 51.996, "Group 6", 4, 2180.0, 6),
    ("Ni", "1.91", 58.693, "Group 10", 4, 1728.0, 10),
    ("Sm", "1.17", 150.36, "Lanthanide", 6, 1345.0, 8),
    ("Al", "1.61", 26.982, "Group 13", 3, 933.47, 3),
    ("Si", "1.90", 28.085, "Group 14", 3, 1687.0, 4),
    ("B", "2.04", 10.81, "Group 13", 2, 2349.0, 3),
    ("N", "3.04", 14.007, "Group 15", 2, 63.15, 5),
    ("S", "2.58", 32.06, "Group 16", 3, 388.36, 6),
    ("Zr", "1.33", 91.224, "Group 4", 5, 2128.0, 4),
    ("Ge", "2.01", 72.63, "Group 14", 4, 1211.4, 4),
    ("C", "2.55", 12.011, "Group 14", 2, 3823.0, 4),
    ("Ta", "1.50", 180.948, "Group 5", 6, 3290.0, 5),
    ("Sb", "2.05", 121.76, "Group 15", 5, 903.78, 5),
    ("Nb", "1.60", 92.906, "Group 5", 5, 2750.0, 5),
    ("Sc", "1.36", 44.956, "Group 3", 4, 1814.0, 3),
    ("Mo", "2.16", 95.95, "Group 6", 5, 2896.0, 6),
    ("Ce", "1.12", 140.116, "Lanthanide", 6, 1068.0, 4),
    ("Te", "2.10", 127.6, "Group 16", 5, 722.66, 6),
    ("Se", "2.55", 78.971, "Group 16", 4, 494.0, 6),
    ("Rh", "2.28", 102.906, "Group 9", 5, 2237.0, 9),
    ("Au", "2.54", 196.967, "Group 11", 6, 1337.33, 11),
    ("Pd", "2.20", 106.42, "Group 10", 5, 1828.05, 10),
    ("V", "1.63", 50.942, "Group 5", 4, 2183.0, 5),
    ("Sn", "1.96", 118.71, "Group 14", 5, 505.08, 4),
    ("O", "3.44", 15.999, "Group 16", 2, 54.36, 6),
]


def sample_elements(spark: SparkSession) -> DataFrame:
    """The built-in element table."""
    return inline_table(spark, ELEMENT_SCHEMA, SAMPLE_ELEMENTS)


def sample_pairs(spark: SparkSession) -> DataFrame:
    """Placeholder pair enthalpies ``2 - 10 (en_a - en_b)^2`` for ``a < b``, without Sm-Zr; not physical."""
    en = {row[0]: float(row[1]) for row in SAMPLE_ELEMENTS}
    rows = [(a, b, 2.0 - 10.0 * (en[a] - en[b]) ** 2) for a, b in combinations(sorted(en), 2) if (a, b) != ("Sm", "Zr")]
    return inline_table(spark, PAIR_SCHEMA, rows)


def read_elements(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Load the element dimension by column name; order does not matter and other columns are left out."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    missing = [n for n in ELEMENT_SCHEMA.names if n not in raw.columns]
    if missing:
        raise ValueError(f"the element table lacks the columns {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in ELEMENT_SCHEMA])


def electronegativity_value(text: Column) -> Column:
    """First decimal number in a text, such as ``1.83`` in ``1.83 (Pauling)``; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"\d*\.\d+", 0), F.lit("")).try_cast("double")


def group_number(text: Column) -> Column:
    """First run of digits in a text, such as ``8`` in ``Group 8``; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("double")


def symmetric_pairs(matrix: DataFrame, row_label: str) -> DataFrame:
    """Long symmetric pair table from a wide matrix read from one triangle.

    Missing cells count as zero and the matrix is added to its transpose, so a value given in one triangle
    appears in both; the diagonal doubles, which no pair of distinct elements reads.
    """
    columns = [c for c in matrix.columns if c != row_label]
    cells = matrix.unpivot(row_label, columns, "b", "h").toDF("a", "b", "h")
    cells = cells.withColumn("h", F.coalesce(F.when(~F.isnan("h"), F.col("h")), F.lit(0.0)))
    both = F.array(
        F.struct("a", "b", "h"),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("h")),
    )
    return cells.select(F.inline(both)).groupBy("a", "b").agg(F.sum("h").alias("h"))


def read_pair_matrix(spark: SparkSession, path: str, row_label: str = "element") -> DataFrame:
    """Load a wide CSV pair matrix (one row per element, one column per symbol) as a symmetric long table.

    Symbols come from the header, in any order. An element of the matrix must have both a row and a column; elements
    that it does not have get no pairs.
    """
    raw = spark.read.option("header", True).csv(path)
    if row_label not in raw.columns:
        raise ValueError(f"the pair matrix lacks the column {row_label}")
    symbols = [c for c in raw.columns if c != row_label]
    # One row per element.
    rows = [r[0] for r in raw.select(F.col(f"`{row_label}`")).collect()]
    odd = sorted(set(symbols) ^ {str(r) for r in rows}) + sorted({r for r in rows if rows.count(r) > 1})
    if odd:
        raise ValueError(f"rows and columns of the pair matrix differ in {', '.join(odd)}")
    wide = raw.select(f"`{row_label}`", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in symbols])
    return symmetric_pairs(wide, row_label)


def symbols_by_length(elements: DataFrame) -> DataFrame:
    """Symbols, longest first; ties in alphabetical order."""
    return elements.select("symbol", F.length("symbol").alias("len")).orderBy(F.desc("len"), "symbol")


def known_symbols(elements: DataFrame, max_symbols: int = 200) -> list[str]:
    """The symbols of the element dimension as a short list, for array literals and fixed pivots."""
    rows = elements.select("symbol").limit(max_symbols + 1).collect()
    if len(rows) > max_symbols:
        raise ValueError(f"an element table has at most {max_symbols} symbols")
    return sorted({r.symbol for r in rows})
