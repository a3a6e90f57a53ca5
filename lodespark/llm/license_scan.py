"""License scan: sparse TF-IDF cosine to license templates, then inheritance along directories.

Units are the lines of a whole text that hold a cue word, and the text itself if it has such a line. A unit's vector
has a weight ``tf * idf`` per token; document frequencies of all template tokens are counted over all files, a token that
no template has counts as one that no file has. A line or text is under the license whose template is nearest, if the
cosine is at least ``LEAST_COSINE``. A file's own license is that of its best unit. A file whose whole text is near a
template is a license file: it gives its license to its directory, and files without a license of their own get that of
the nearest directory above them that has one.

Equal units are scored once. Directories are joined to their ancestors as distinct rows, so a directory with many files
is no hot key there. Only DataFrame functions are used.

Defined cases: null and empty texts have no license of their own; a null path is the file ``""`` in the root directory;
rows with equal paths are scored row by row; where cosines tie, the first license by name counts, of a directory's
license files too; an empty table gives no rows; columns named as the
result's are replaced, other extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.llm.common import saved
from lodespark.session import bounded_broadcast, inline_table

LEAST_COSINE = 0.5
TOKEN = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
RESULT = ("path", "own_license", "own_score", "license_file", "license", "license_from")
CUE = r"(?i)licen[sc]e|copyright|spdx|public domain|all rights reserved"

#: Names and usual notices of licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 License CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This source code is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "Copyright. All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def template_terms(spark: SparkSession) -> DataFrame:
    """(license, token, tf) of the templates."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("license", "notice")])
    rows = inline_table(spark, schema, list(TEMPLATES))
    return rows.select("license", F.explode(tokens(F.col("notice"))).alias("token")).groupBy("license", "token").agg(
        F.count("*").alias("tf")
    )


def token_weights(files: DataFrame) -> DataFrame:
    """(token, idf) of every template token over all ``files``, and under a null token that of any other."""
    terms = template_terms(files.sparkSession)
    vocabulary = terms.select("token").distinct()
    known = F.array(*[F.lit(r["token"]) for r in vocabulary.collect()])
    held = files.select(F.explode(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), known)).alias("token"))
    total = files.agg(F.count("*").alias("files"))
    counted = vocabulary.join(held.groupBy("token").agg(F.count("*").alias("df")), "token", "left")
    either = counted.select("token", F.coalesce("df", F.lit(0)).alias("df")).union(
        files.sparkSession.range(1).select(F.lit(None).cast("string"), F.lit(0).cast("long"))
    )
    # One row beside at most as many as the templates have tokens.
    return either.join(F.broadcast(total)).select(
        "token", (F.log((1 + F.col("files")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def unit_licenses(units: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, license, cosine) of every different ``unit`` that is near enough to a template; ``id`` is its digest.

    Units are dealt by id once; tokens, lengths and products are then summed where they are.
    """
    named = weights.filter("token IS NOT NULL")
    other = weights.filter("token IS NULL").select(F.col("idf").alias("other"))
    templates = template_terms(units.sparkSession).join(named, "token").withColumn("part", F.col("tf") * F.col("idf"))
    lengths = templates.groupBy("license").agg(F.sqrt(F.sum(F.col("part") * F.col("part"))).alias("length"))
    parts = (
        templates.join(lengths, "license")
        .groupBy("token", "idf")
        .agg(F.map_from_entries(F.collect_list(F.struct("license", F.col("part") / F.col("length")))).alias("parts"))
    )
    # Both sides hold at most one row per token of the templates.
    terms = (
        units.select("id", "unit")
        .dropDuplicates(["id"])
        .select("id", F.explode(tokens(F.col("unit"))).alias("token"))
        .groupBy("id", "token")
        .agg(F.count("*").alias("tf"))
        .join(F.broadcast(parts), "token", "left")
        .join(F.broadcast(other))
        .withColumn("weight", F.col("tf") * F.coalesce("idf", "other"))
    )
    names = [name for name, _ in TEMPLATES]
    product = lambda name: F.sum(F.col("weight") * F.coalesce(F.col("parts")[name], F.lit(0.0)))
    summed = terms.groupBy("id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"),
        F.array(*[F.struct(product(name).alias("product"), F.lit(name).alias("license")) for name in names]).alias("near"),
    )
    cosines = F.transform(
        "near", lambda x: F.struct((-F.round(x["product"] / F.col("length"), 9)).alias("far"), x["license"].alias("license"))
    )
    return (
        summed.select("id", F.array_min(cosines).alias("best"))
        .filter(F.col("best.far") <= -LEAST_COSINE)
        .select("id", F.col("best.license").alias("license"), (-F.col("best.far")).alias("cosine"))
    )


def parent(path: Column) -> Column:
    """Directory of a path; ``""`` is the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """A directory and all above it as (name, depth), the root has depth 0."""
    steps = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("name"), n.alias("depth")),
    )


def scan(files: DataFrame, path: Column) -> DataFrame:
    """``files`` (with a text) with path, own_license, own_score, license_file, license and license_from.

    ``license`` is the own or the inherited one, ``license_from`` the directory that it is inherited from.
    """
    kept = [F.col(f"`{c}`") for c in files.columns if c.lower() not in RESULT]
    rows = files.select(*kept, F.coalesce(path, F.lit("")).alias("path"))
    cued = rows.filter(F.col("text").rlike(CUE)).select("path", "text")
    lines = F.filter(F.split("text", "\r\n|\n|\r"), lambda line: line.rlike(CUE))
    unit = F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))
    each = F.transform(F.array_distinct(lines), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    units = saved(
        cued.select(
            "path",
            F.xxhash64("text").alias("__text"),
            F.explode(F.concat(each, F.array(unit))).alias("u"),
        ).select("path", "__text", "u.whole", "u.unit", F.sha2("u.unit", 256).alias("id")),
        "license-units",
    )
    weights = saved(token_weights(rows), "license-weights")
    found = units.drop("unit").join(unit_licenses(units, weights), "id")
    own = saved(
        found.groupBy("path", "__text")
        .agg(
            F.min(F.struct((-F.col("cosine")).alias("far"), "license")).alias("best"),
            F.min(F.when(F.col("whole"), F.struct((-F.col("cosine")).alias("far"), "license"))).alias("__file"),
        )
        .select(
            "path",
            "__text",
            F.col("best.license").alias("own_license"),
            (-F.col("best.far")).alias("own_score"),
            "__file",
        ),
        "license-own",
    )
    givers = (
        own.filter("__file IS NOT NULL")
        .groupBy(parent(F.col("path")).alias("name"))
        .agg(F.min("__file").alias("__file"))
        .select("name", F.col("__file.license").alias("__given"))
    )
    directories = rows.select(parent(F.col("path")).alias("__directory")).distinct()
    inherited = (
        directories.select("__directory", F.explode(ancestors(F.col("__directory"))).alias("above"))
        .select("__directory", "above.name", "above.depth")
        .join(givers, "name")
        .groupBy("__directory")
        .agg(F.max(F.struct("depth", "name", "__given")).alias("nearest"))
        .select("__directory", F.col("nearest.name").alias("__from"), F.col("nearest.__given").alias("__given"))
    )
    return (
        rows.withColumns({"__text": F.xxhash64("text"), "__directory": parent(F.col("path"))})
        .join(own, ["path", "__text"], "left")
        .join(bounded_broadcast(inherited), "__directory", "left")
        .select(
            *kept,
            "path",
            "own_license",
            "own_score",
            F.col("__file").isNotNull().alias("license_file"),
            F.coalesce("own_license", "__given").alias("license"),
            F.when(F.col("own_license").isNull(), F.col("__from")).alias("license_from"),
        )
    )
