"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed words, of its word pairs, hashed by the difference of the
two words' hashes so that all repetitions of a word share one bucket, and of the hashed character n-grams of its words
with a blank on either side. Two softmax outputs sit on top. Training is plain stochastic gradient descent in numpy over
a bounded sample of labelled documents. As the outputs are linear in the mean, scoring needs one number per bucket,
``vector . (w1 - w0)``; a score is the logistic function of their mean and the bias.

At most about ``SAMPLE_TEXTS`` labelled rows are learned from, picked by a hash of the id; every whole text is scored.

Defined cases: null and empty texts have no feature and get the score of the bias alone; without labelled rows to
learn from every score is 0.5; rows whose label is null are not learned; where rows of one id carry several labels or
texts each pair is one example. Ids are handed through, null and repeated ones too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.llm.common import code_points, packs, unit_hash

#: Labelled texts learned from, as expected number; the bound of the sample.
SAMPLE_TEXTS = 3000
BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
DIMENSIONS = 8
EPOCHS = 8
RATE = 0.5
SEED = 11
THRESHOLD = 0.7

FEATURES_SCHEMA = "doc_id long, label int, buckets binary, weights binary"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


@dataclass
class QualityModel:
    """``values``: what each bucket adds to the mean; ``bias``: what is there without any."""

    values: np.ndarray
    bias: float


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


def features(parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, word pairs and n-grams of the padded parts: one (buckets, edges of each part) per kind of feature."""
    codes, starts = code_points(parts)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    c = np.where(blank, 32, codes).astype(np.uint64)
    out = []
    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(first):
        place = np.arange(len(c)) - first[np.maximum(np.searchsorted(first, np.arange(len(c)), "right") - 1, 0)]
        power = np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64).cumprod()
        term = np.where(blank, np.uint64(0), (c + np.uint64(1)) * power[place & 63])
        words = np.add.reduceat(term, first)
        out.append((_mixed(words), np.searchsorted(first, starts)))
        part = np.searchsorted(starts, first, "right")
        follows = np.flatnonzero(part[1:] == part[:-1])
        difference = (words[1:] - words[:-1])[follows] + np.uint64(0x94D049BB133111EB)
        out.append((_mixed(difference), np.searchsorted(first[follows], starts)))
    for n in GRAMS:
        size = len(c) - n + 1
        if size <= 0:
            continue
        inner = ~blank[1 : 1 + size] if n > 2 else ~(blank[:size] & blank[1 : 1 + size])
        h = np.full(size, n, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + size]
            if 1 < i < n - 1:
                inner = inner & ~blank[i : i + size]
        at = np.flatnonzero(inner)
        out.append((_mixed(h[at]), np.searchsorted(at, starts)))
    return out


def _document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and each one's part of all its features."""
    found = [b for _, parts in packs([text]) for b, _ in features(parts)]
    buckets, n = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_counts=True)
    return buckets.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [_document_features(t or "") for t in batch.column(2).to_pylist()]
        columns = [pa.array([p[i].tobytes() for p in pairs], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *columns], names=["doc_id", "label", "buckets", "weights"]
        )


def descend(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> QualityModel:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((2, DIMENSIONS), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            buckets, part = examples[k]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = part @ vectors[buckets]
            logits = weights @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[k]] -= 1
            back = weights.T @ error
            weights -= rate * np.outer(error, hidden)
            bias -= 0.1 * rate * error
            # A document has over a thousand features, each with a thousandth of the gradient: scale it to one feature.
            vectors[buckets] -= rate * np.sqrt(len(buckets)) * part[:, None] * back
    return QualityModel(vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, sample_texts: int = SAMPLE_TEXTS) -> QualityModel:
    """Learn from rows of ``labels`` (doc_id, quality) that ``learnable`` marks, joined to their texts.

    The driver gets the features of the sample and holds no text.
    """
    rows = labels.filter(learnable & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    share = min(1.0, sample_texts / max(1, rows.count()))
    sample = rows.filter(unit_hash(F.col("doc_id"), seed="quality") < share)
    table = (
        sample.join(docs.select("doc_id", "text"), "doc_id")
        .selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(label AS INT) label", "text")
        .mapInArrow(_featurise, FEATURES_SCHEMA)
        .toArrow()
    )
    if not table.num_rows:
        return QualityModel(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    raw = [table.column(i).to_pylist() for i in range(4)]
    order = sorted(range(table.num_rows), key=lambda i: (raw[0][i], raw[1][i], raw[2][i]))
    examples = [(np.frombuffer(raw[2][i], np.int32), np.frombuffer(raw[3][i], np.float32)) for i in order]
    return descend(examples, np.array([raw[1][i] for i in order]))


def scores(model: QualityModel, texts: list[str]) -> np.ndarray:
    """Probability of label 1 of each text."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, parts in packs(texts):
        for buckets, edges in features(parts):
            run = np.concatenate([[0.0], np.cumsum(model.values[buckets], dtype=np.float64)])
            np.add.at(total, rows, run[edges[1:]] - run[edges[:-1]])
            np.add.at(n, rows, np.diff(edges))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -50, 50)))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(shared.value, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=SCHEMA.names)

    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text").mapInArrow(predict, SCHEMA)
