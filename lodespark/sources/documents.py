"""Nested property documents to typed flat rows, with malformed documents set aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Document keys by section, in document order, with the type of each value.
SECTIONS: dict[str, dict[str, str]] = {
    "chemistry": {
        "chemical formula": "string",
        "production info": "string",
    },
    "crystal": {
        "compound space group": "int",
        "unit cell volume": "double",
        "lattice parameters": "array<double>",
        "lattice angles": "array<double>",
        "atomic positions": "array<string>",
        "crystal info": "string",
    },
    "magnetics": {
        "unit cell spin polarization": "double",
        "atomic spin specie": "array<string>",
        "saturation magnetization": "double",
        "magnetization temperature": "double",
        "magnetization info": "string",
        "magnetocrystalline anisotropy energy": "double",
        "anisotropy energy type": "string",
        "magnetocrystalline anisotropy constants": "array<double>",
        "kind of anisotropy": "string",
        "anisotropy info": "string",
        "exchange integrals": "string",
        "exchange info": "string",
        "magnetic order": "string",
        "curie temperature": "double",
        "curie temperature info": "string",
        "anisotropy field": "double",
        "remanence": "double",
        "coercivity": "double",
        "energy product": "double",
        "hysteresis info": "string",
        "domain wall width": "double",
        "domain wall info": "string",
        "exchange stiffness": "double",
        "exchange stiffness info": "string",
    },
}
# Texts that mean a missing value.
NULL_LITERALS = ["none", "None"]
CORRUPT = "_corrupt_record"
# The start of a value wrapper, and wrappers of a text without escapes, a whole number that fits 64 bits or
# a truth value, of which JSON readers return exactly the characters.
WRAPPER = '{"value":'
PLAIN_WRAPPER = r'\A\{"value":(?:"[^"\\\x00-\x1f]*"|0|-?[1-9][0-9]{0,17}|true|false)\}\z'
# An array of at most 16 numbers without exponent, sign of a whole zero or space.
_NUMBER = r"(?:0|-?[1-9][0-9]{0,17}|-?(?:0|[1-9][0-9]{0,17})\.[0-9]{1,17})"
PLAIN_NUMBERS = rf"\A\[{_NUMBER}(?:,{_NUMBER}){{0,15}}\]\z"


SECTION_TYPE = "map<string,string>"


def document_schema() -> str:
    """Declared document schema. A section is a map whose values stay JSON text, whatever shape they have."""
    sections = ",".join(f"{name}:{SECTION_TYPE}" for name in SECTIONS)
    return f"array<struct<properties:struct<{sections}>>>"


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Scan a folder tree for ``*.json`` property documents (Latin-1, one document per file).

    Whole files are read as bytes and packed into tasks by size. Malformed files stay in the result with their text
    in ``_corrupt_record``; ``path`` names the file.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .load(root)
        .select("path", F.decode("content", "ISO-8859-1").alias("doc"))
    )
    return parse_documents(files, "doc", ["path"])


def parse_documents(df: DataFrame, column: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """Parse documents held as JSON text; the same result shape as :func:`read_documents`.

    The text is read as the only element of an array, so text after the document or a second document is malformed.
    """
    kept = keep or []
    parsed = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), document_schema())
    rows = df.select(*kept, F.col(column).alias("_text"), F.explode(F.array(parsed)).alias("_d"))
    whole = F.coalesce(F.size("_d") == 1, F.lit(False))
    return rows.select(
        *kept, F.get("_d", F.lit(0))["properties"].alias("properties"), F.when(~whole, F.col("_text")).alias(CORRUPT)
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """Documents that could be read."""
    return docs.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined_documents(docs: DataFrame) -> DataFrame:
    """Malformed documents: everything but the parsed part."""
    return docs.where(F.col(CORRUPT).isNotNull()).drop("properties")


def document_status(docs: DataFrame) -> DataFrame:
    """All documents with ``status`` good or malformed, without the parsed part: one pass counts both."""
    status = F.when(F.col(CORRUPT).isNull(), F.lit("good")).otherwise(F.lit("malformed"))
    return docs.withColumn("status", status).drop("properties", CORRUPT)


def unwrap(node: Column) -> Column:
    """Replace a JSON object whose only key is ``value`` by that value; anything else stays as it is.

    A parser costs more than the short texts it reads, so texts without a brace and plain wrappers are told by their
    characters; only the rest is parsed.
    """
    inner = node.substr(F.lit(len(WRAPPER) + 1), F.length(node) - F.lit(len(WRAPPER) + 1))
    wrapped = F.json_object_keys(node) == F.array(F.lit("value"))
    return (
        F.when(~F.contains(node, F.lit("{")), node)
        .when(node.rlike(PLAIN_WRAPPER), F.btrim(inner, F.lit('"')))
        .when(wrapped, F.get_json_object(node, "$.value"))
        .otherwise(node)
    )


def merge_sections(*sections: Column) -> Column:
    """Union of maps in which a later map wins on equal keys, even when its value is null."""
    def laid_over(earlier: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(earlier, lambda k, v: ~F.map_contains_key(later, k)), later)

    return reduce(laid_over, sections)


def merged_documents(docs: DataFrame, keep: list[str] | None = None, out: str = "leaves") -> DataFrame:
    """One map of all leaves per readable document; a later section wins on equal keys."""
    empty = F.create_map().cast(SECTION_TYPE)
    sections = [F.coalesce(F.col(f"properties.{name}"), empty) for name in SECTIONS]
    return good_documents(docs).select(*(keep or []), F.explode(F.array(merge_sections(*sections))).alias(out))


def leaf(key: str) -> Column:
    """The leaf that :func:`merged_documents` has under a key, looked up without building the map."""
    found = F.lit(None).cast("string")
    for name in SECTIONS:
        section = F.col(f"properties.{name}")
        found = F.when(F.map_contains_key(section, key), F.try_element_at(section, F.lit(key))).otherwise(found)
    return found


def flatten_documents(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One flat row per readable document: 32 columns, sections merged, value wrappers removed, everything still text."""
    keys = [key for keys in SECTIONS.values() for key in keys]
    return good_documents(docs).select(*(keep or []), *[unwrap(leaf(key)).alias(key) for key in keys])


def normalise_null_literals(df: DataFrame, literals: list[str] = NULL_LITERALS) -> DataFrame:
    """Turn the texts that mean missing into nulls, in every string column; exact match only."""
    return df.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(literals), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def retype(df: DataFrame) -> DataFrame:
    """Cast the flat text columns to their declared types; what does not parse becomes null.

    An array is null where the text is none; its numbers are null one by one.
    """
    kinds = {key: kind for keys in SECTIONS.values() for key, kind in keys.items()}

    def typed(name: str) -> Column:
        col, kind = F.col(f"`{name}`"), kinds.get(name, "string")
        if kind.startswith("array"):
            values = F.from_json(col, "array<string>")
            if kind == "array<double>":
                # Plain numbers between commas need no parser to become doubles.
                values = F.when(col.rlike(PLAIN_NUMBERS), F.split(F.btrim(col, F.lit("[]")), ",")).otherwise(values)
                values = F.transform(values, lambda v: v.try_cast("double"))
            return values.alias(name)
        return (col if kind == "string" else col.try_cast(kind)).alias(name)

    return df.select(*[typed(c) for c in df.columns])


def load_property_rows(spark: SparkSession, root: str) -> DataFrame:
    """Read, flatten, normalise and type a folder of property documents."""
    return retype(normalise_null_literals(flatten_documents(read_documents(spark, root))))


def first_anisotropy(
    df: DataFrame, column: str = "magnetocrystalline anisotropy constants", out: str | None = None
) -> DataFrame:
    """First anisotropy constant K1 of the array; null and empty arrays give null."""
    return df.withColumn(out or column, F.get(F.col(f"`{column}`"), F.lit(0)))
