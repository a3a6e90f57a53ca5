"""Token counts: texts are encoded in Arrow batches that return lengths only.

The tokenizer of ``vocabulary`` treats white space as a break and drops it, so a text may be cut at any ASCII white
space without changing its tokens. Texts are cut there into words; words not met before are encoded together in
batches of equal bytes, and a task remembers the counts of short words. Long texts are worked off part by part.

Defined cases: a null or empty text has 0 bytes and 0 tokens; ids are handed through as they are, null and repeated
ones too; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Most words whose counts a task remembers, and most bytes of such a word.
CACHE_WORDS = 400_000
CACHE_WORD_BYTES = 48
#: Bytes encoded in one call, and bytes of a text that are split at once.
BATCH_BYTES = 1 << 19
PART_BYTES = 1 << 20
LIMIT = 2048

SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_tokens")])


class WordCounter:
    """Tokens per word of a tokenizer that never joins words across white space."""

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def _encode(self, words: list[bytes]) -> Iterator[int]:
        batch, held = [], 0
        for word in words:
            if held and held + len(word) > BATCH_BYTES:
                yield from map(len, self.tokenizer.encode_batch(batch, add_special_tokens=False))
                batch, held = [], 0
            batch.append(word.decode("utf-8", "replace"))
            held += len(word)
        if batch:
            yield from map(len, self.tokenizer.encode_batch(batch, add_special_tokens=False))

    def counts(self, texts: list[list[bytes]]) -> list[int]:
        """Tokens of each list of words."""
        known = self.known
        new = list({w for words in texts for w in words} - known.keys())
        known.update(zip(new, self._encode(new)))
        out = [sum(map(known.__getitem__, words)) for words in texts]
        for word in new:
            if len(word) > CACHE_WORD_BYTES:
                del known[word]
        if len(known) > CACHE_WORDS:
            known.clear()
        return out


def parts(data: bytes) -> Iterator[bytes]:
    """Cut a text before white space into parts of about ``PART_BYTES``; a longer word stays whole."""
    start = 0
    while len(data) - start > PART_BYTES:
        cut = max(data.rfind(c, start + 1, start + PART_BYTES) for c in (b" ", b"\n", b"\t"))
        if cut < 0:
            found = [i for c in (b" ", b"\n", b"\t") if (i := data.find(c, start + PART_BYTES)) >= 0]
            cut = min(found, default=len(data))
        yield data[start:cut]
        start = cut
    yield data[start:]


def _bundles(texts: list[bytes]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(row, words) lists whose texts have about ``PART_BYTES`` together."""
    bundle, held = [], 0
    for row, text in enumerate(texts):
        for part in parts(text):
            if held and held + len(part) > PART_BYTES:
                yield bundle
                bundle, held = [], 0
            bundle.append((row, part.split()))
            held += len(part)
    if bundle:
        yield bundle


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row. ``vocabulary_path`` is read on the driver and sent to the tasks."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(vocabulary.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tokens = np.zeros(len(texts), dtype=np.int64)
            for bundle in _bundles(texts):
                for (row, _), n in zip(bundle, counter.counts([words for _, words in bundle])):
                    tokens[row] += n
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens)], names=SCHEMA.names)

    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text").mapInArrow(count, SCHEMA)
