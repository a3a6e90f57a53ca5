"""Language ID with language-bitmask n-gram filters.

A filter is a Bloom filter in bit slices: each slot is a mask with one bit per language, and looking up an n-gram is
the AND of its slots, which gives all languages that contain it at once. A document is decided by the popcount of each
language over its n-grams, less the false positives that the filling of that language's slice leads to expect.

N-grams are three and four lower-case letters in a row, where a word's first and last may be a blank. An n-gram is put
in for a language if enough of its learning texts have it, and at least ``RATIO`` of the share that the language with
most has. At most about ``SAMPLE_TEXTS`` texts of each language are learned from, picked by a hash of the id; all
texts are predicted.

Defined cases: null texts and texts without letters are ``und`` with score 0; letters that no filter knows give the
language with most learning texts, score 0; ties go to the first language by code point; without any language to learn
all is ``und``. Ids are handed through, null and repeated ones too; null and empty language names are not learned;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.llm.common import code_points, packs, span_sums, unit_hash

#: Learning texts of each language, as expected number; the bound of the sample.
SAMPLE_TEXTS = 2500
#: Share of a language's learning texts that must have an n-gram, and the least part of the largest share.
LEAST_SHARE = 0.004
RATIO = 0.25
SLOTS = 1 << 20
PROBES = 3
UNDETERMINED = "und"

GRAMS_SCHEMA = "lang string, gram long, n long"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_grams", T.LongType()),
    ]
)


@dataclass
class LanguageFilter:
    """``masks[b, slot]``: languages 8b to 8b + 7, in the order of ``langs``; ``false[l]``: rate of false positives."""

    langs: list[str]
    masks: np.ndarray
    false: np.ndarray
    default: int


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts, their places, and the edges of each text's span of places."""
    codes, starts = code_points([p.lower() for p in parts])
    letter = _is_letter()[codes]
    c = np.where(letter, codes, 32).astype(np.uint64)
    found, places = [], []
    for n in (3, 4):
        size = len(c) - n + 1
        if size <= 0:
            continue
        inner = letter[1 : 1 + size].copy()
        h = np.full(size, n, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + size]
            if 1 < i < n - 1:
                inner &= letter[i : i + size]
        at = np.flatnonzero(inner)
        h = h[at]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(h ^ (h >> np.uint64(32)))
        places.append(at)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return np.concatenate(found)[order], at[order], starts


def slots(grams: np.ndarray) -> list[np.ndarray]:
    bits = SLOTS.bit_length() - 1
    return [((grams >> np.uint64(bits * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def lookup(model: LanguageFilter, grams: np.ndarray) -> list[np.ndarray]:
    """Masks of the languages that contain each n-gram, eight languages an array."""
    where = slots(grams)
    out = []
    for plane in model.masks:
        mask = plane[where[0]]
        for w in where[1:]:
            mask &= plane[w]
        out.append(mask)
    return out


def popcounts(model: LanguageFilter, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: n-grams, those found per language, and whether it has a letter."""
    n = np.zeros(len(texts), dtype=np.int64)
    hits = np.zeros((len(texts), len(model.langs)), dtype=np.int64)
    for rows, parts in packs(texts):
        grams, at, starts = ngrams(parts)
        edges = np.searchsorted(at, starts)
        np.add.at(n, rows, np.diff(edges))
        planes = lookup(model, grams)
        for lang in range(len(model.langs)):
            bit = (planes[lang // 8] >> np.uint8(lang % 8)) & np.uint8(1)
            np.add.at(hits[:, lang], rows, span_sums(bit, at, starts))
    return n, hits, n > 0


def decide(model: LanguageFilter, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of n-grams of each text. Score: the part of the n-grams the language explains."""
    n, hits, lettered = popcounts(model, texts)
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), n
    expected = n[:, None] * model.false
    true = np.clip((hits - expected) / (1 - model.false), 0, None)
    best = np.where(true.max(axis=1) > 0, true.argmax(axis=1), model.default)
    score = np.clip(true.max(axis=1) / np.maximum(n, 1), 0, 1)
    return [model.langs[b] if known else UNDETERMINED for b, known in zip(best, lettered)], score, n


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each language that have an n-gram, summed over a batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            seen = []
            for text in (t for t, l in zip(texts, langs) if l == lang):
                own = [np.unique(ngrams(parts)[0]) for _, parts in packs([text])]
                seen.append(np.unique(np.concatenate(own)))
            grams, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"],
            )


def learn(
    docs: DataFrame, learnable: Column, sample_texts: int = SAMPLE_TEXTS, least_share: float = LEAST_SHARE
) -> LanguageFilter:
    """Build the filter from the rows of (doc_id, text, lang) that ``learnable`` marks.

    The driver gets one row per language and the slots of the filter, whose number is fixed.
    """
    rows = docs.filter(learnable & (F.col("lang") != "") & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    planes = max(1, -(-len(langs) // 8))
    masks = np.zeros((planes, SLOTS), dtype=np.uint8)
    if not langs:
        return LanguageFilter([], masks, np.zeros(0), 0)
    share = F.element_at(
        F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_texts / sizes[lang]))]), F.col("lang")
    )
    sample = rows.filter(unit_hash(F.col("doc_id"), seed="language") < share).select("lang", "text")
    grams = sample.mapInArrow(_count_grams, GRAMS_SCHEMA).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    learned = F.element_at(
        F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(min(sizes[lang], sample_texts)))]), F.col("lang")
    )
    place = F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)]), F.col("lang"))
    entries = (
        grams.withColumn("share", F.col("n") / learned)
        .filter(F.col("share") >= least_share)
        .groupBy("gram")
        .agg(F.collect_list(F.struct("share", place.alias("place"))).alias("shares"))
        .withColumn("most", F.array_max(F.transform("shares", lambda x: x["share"])))
        .select("gram", F.explode("shares").alias("entry"), "most")
        .filter(F.col("entry.share") >= RATIO * F.col("most"))
    )
    bits = SLOTS.bit_length() - 1
    probes = F.array(
        *[F.shiftrightunsigned("gram", bits * i).bitwiseAND(F.lit(SLOTS - 1)) for i in range(PROBES)]
    )
    filled = (
        entries.select(F.explode(probes).alias("slot"), F.col("entry.place").alias("place"))
        .groupBy("slot", F.floor(F.col("place") / 8).alias("plane"))
        .agg(F.bit_or(F.expr("shiftleft(1, CAST(place % 8 AS INT))")).alias("mask"))
        .toArrow()
    )
    slot, plane, mask = (filled.column(i).to_numpy() for i in range(3))
    masks[plane.astype(np.int64), slot.astype(np.int64)] = mask.astype(np.uint8)
    filling = np.array([((masks[i // 8] >> np.uint8(i % 8)) & 1).mean() for i in range(len(langs))])
    return LanguageFilter(langs, masks, filling**PROBES, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, lang_pred, score, n_grams) of every row of ``docs``, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, n = decide(shared.value, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(n)], names=SCHEMA.names
            )

    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text").mapInArrow(predict, SCHEMA)


def keep_determined(docs: DataFrame, model: LanguageFilter, least_score: float) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least ``least_score``; without any language, those with letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def determined(texts: pd.Series) -> pd.Series:
        langs, score, n = decide(shared.value, [t or "" for t in texts])
        if not shared.value.langs:
            return pd.Series(n > 0)
        return pd.Series([lang != UNDETERMINED for lang in langs]) & pd.Series(score >= least_score)

    return docs.filter(determined("text"))
