"""Benchmark decontamination by q-gram lemma filtering.

A document is contaminated by a benchmark item if some region of it is the item with at most ``k`` character edits,
``k`` being ``EDIT_RATE`` of the item's length, both in lower case with each run of white space as one blank. Every
edit destroys at most q q-grams, so the region shares ``m - q + 1 - k q`` q-grams with an item of length m, all of them
on k + 1 neighbouring diagonals (place in the text less place in the item). Shared q-grams are counted in bands of
2 (k + 1) diagonals that overlap by half, so that one band holds them all; regions of bands that reach the count are
kept and verified by banded alignment. An item's most frequent q-grams, half as many as it needs, are not looked up;
the count that it needs falls by their number, so no region is lost.

Documents are worked off where they are read. Items are the query set: they are sent to the tasks in blocks of at most
``BLOCK_CHARS`` characters, each block against all rows. Long documents are scanned in windows that overlap by more
than a region.

Defined cases: null and empty texts match nothing; an item shorter than q characters is no evidence and matches
nothing; items with equal texts are all reported; where regions tie, the one that ends first counts; every row of a
repeated document gives its own rows; either table may be empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q = 8
EDIT_RATE = 0.1
#: Characters of benchmark items that are sent to the tasks at once.
BLOCK_CHARS = 4_000_000
#: Characters scanned together.
WINDOW = 1 << 18
FILTER_BITS = 20

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("distance", "start", "end")]
)
COST = 1 << 32
NOWHERE = 0xFFFFFFFF


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams."""
    size = max(0, len(codes) - q + 1)
    h = np.zeros(size, dtype=np.uint64)
    for i in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i : i + size]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


@dataclass
class ItemIndex:
    """Items by different normalised text, and where each q-gram stands in them."""

    texts: list[str]
    codes: list[np.ndarray]
    ids: list[list[int]]
    budget: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    q: int


def build_index(items: list[tuple[int, str | None]], q: int = Q, edit_rate: float = EDIT_RATE) -> ItemIndex:
    by_text: dict[str, list[int]] = {}
    for item_id, text in items:
        if text is not None and len(norm := normalised(text)) >= q:
            by_text.setdefault(norm, []).append(item_id)
    texts = sorted(by_text)
    codes = [_codes(t) for t in texts]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    # Never more edits than leave one q-gram to look for.
    budget = np.minimum((edit_rate * sizes + 1e-9).astype(np.int64), (sizes - q) // q)
    needed = sizes - q + 1 - budget * q
    grams = [qgrams(c, q) for c in codes]
    item = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
    everything = np.concatenate(grams or [np.zeros(0, np.uint64)])
    # Half of the count is not looked for: an item's most frequent q-grams, found everywhere, are left out.
    _, which, often = np.unique(everything, return_inverse=True, return_counts=True)
    by_frequency = np.lexsort((-often[which], item))
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    left_out = needed // 2
    kept = np.sort(by_frequency[rank >= left_out[item]])
    needed = needed - left_out
    everything, item, place = everything[kept], item[kept], place[kept]
    order = np.argsort(everything, kind="stable")
    different, first = np.unique(everything[order], return_index=True)
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[(different >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return ItemIndex(
        texts,
        codes,
        [by_text[t] for t in texts],
        budget,
        needed,
        different,
        np.append(first, len(everything)),
        item[order],
        place[order],
        bits,
        q,
    )


def shared(index: ItemIndex, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the codes, item, place in the item) of all shared q-grams."""
    h = qgrams(codes, index.q)
    at = np.flatnonzero(index.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    h = h[at]
    slot = np.minimum(np.searchsorted(index.grams, h), max(0, len(index.grams) - 1))
    same = index.grams[slot] == h
    at, slot = at[same], slot[same]
    n = index.first[slot + 1] - index.first[slot]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    entry = np.repeat(index.first[slot], n) + within
    return np.repeat(at, n), index.item[entry], index.place[entry]


def regions(index: ItemIndex, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, lowest diagonal) of every band that reaches its item's count.

    ``starts``: where each text starts in ``codes``, and the end.
    """
    at, item, place = shared(index, codes)
    text = np.searchsorted(starts, at, "right") - 1
    # A q-gram that runs over the end of a text belongs to none.
    whole = at + index.q <= starts[text + 1]
    at, item, place, text = at[whole], item[whole], place[whole], text[whole]
    pair = text * len(index.texts) + item
    # Most pairs of text and item share too few q-grams on all diagonals together.
    different, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (total >= index.needed[different % max(1, len(index.texts))])[inverse]
    at, item, place, text, pair = at[enough], item[enough], place[enough], text[enough], pair[enough]
    if not len(at):
        return []
    stride = index.budget[item] + 1
    half = (at - starts[text] - place) // stride
    low = half.min() - 1
    span = half.max() - low + 2
    keys, n = np.unique(pair * span + (half - low), return_counts=True)
    counts = dict(zip(keys.tolist(), n.tolist()))
    out = []
    for key in sorted({k - 1 for k in counts} | set(counts)):
        row, it = divmod(key // span, len(index.texts))
        if counts.get(key, 0) + counts.get(key + 1, 0) >= index.needed[it]:
            out.append((row, it, int((key % span + low) * (index.budget[it] + 1))))
    return out


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Least edits of ``item`` against a region of ``text`` on the diagonals from ``low``: (edits, start, end).

    None if it takes more than ``budget``. A cell holds its cost and where its path started.
    """
    padded = np.full(len(item) + width, NOWHERE, dtype=np.uint32)
    a, b = max(0, low), min(len(text), low + len(padded))
    if a < b:
        padded[a - low : b - low] = text[a:b]
    column = np.arange(width, dtype=np.int64)
    cells = np.maximum(column + low, 0)
    for i, char in enumerate(item):
        change = cells + np.where(padded[i : i + width] == char, 0, COST)
        change[:-1] = np.minimum(change[:-1], cells[1:] + COST)
        cells = np.minimum.accumulate(change - column * COST) + column * COST
        if cells.min() // COST > budget:
            return None
    ends = np.minimum(column + low + len(item), len(text))
    best = min(zip((cells // COST).tolist(), ends.tolist(), (cells % COST).tolist()))
    return (best[0], best[2], best[1]) if best[0] <= budget else None


def _verified(index: ItemIndex, item: int, text: str, codes: np.ndarray, low: int) -> tuple[int, int, int] | None:
    budget, size = int(index.budget[item]), len(index.texts[item])
    width = 2 * (budget + 1)
    same = text.find(index.texts[item], max(0, low), max(0, low + width + size))
    return (0, same, same + size) if same >= 0 else align(index.codes[item], codes, low, width, budget)


def _windows(text: str, overlap: int) -> Iterator[tuple[int, str]]:
    start = 0
    while True:
        yield start, text[start : start + WINDOW + overlap]
        start += WINDOW
        if start >= len(text):
            return


def scan(index: ItemIndex, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of the best region of every contaminated text and item."""
    if not index.texts:
        return []
    overlap = 2 * max(map(len, index.texts)) + 2 * int(index.budget.max()) + 2
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def work(parts: list[tuple[int, int, str]]) -> None:
        codes = _codes("".join(p for _, _, p in parts))
        starts = np.concatenate([[0], np.cumsum([len(p) for _, _, p in parts])])
        for k, item, low in regions(index, codes, starts):
            row, offset, part = parts[k]
            if found := _verified(index, item, part, codes[starts[k] : starts[k + 1]], low):
                edits, start, end = found
                rank = (edits, end + offset, start + offset)
                best[row, item] = min(best.get((row, item), rank), rank)

    parts, held = [], 0
    for row, text in enumerate(texts):
        for offset, part in _windows(normalised(text), overlap):
            if held and held + len(part) > WINDOW:
                work(parts)
                parts, held = [], 0
            parts.append((row, offset, part))
            held += len(part)
    if parts:
        work(parts)
    return [(row, item, edits, start, end) for (row, item), (edits, end, start) in best.items()]


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``block_chars`` characters, dealt by a hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == block).collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every contaminated document and item, the best region of each.

    ``start`` and ``end`` count characters of the normalised text. ``docs`` needs doc_id and text, ``benchmark``
    item_id and text.
    """
    spark = docs.sparkSession
    found = None
    for items in item_blocks(benchmark, block_chars):
        shipped = spark.sparkContext.broadcast(build_index(items, q, edit_rate))

        def look(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits = scan(index, [t or "" for t in batch.column(1).to_pylist()])
                rows = [(ids[r], i, *place) for r, it, *place in hits for i in index.ids[it]]
                if rows:
                    columns = zip(list(zip(*rows)), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=SCHEMA.names)

        part = docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text").mapInArrow(look, SCHEMA)
        found = part if found is None else found.union(part)
    return found


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Rows of ``docs`` that no item contaminates."""

    def free_of(items: list[tuple[int, str | None]]) -> Column:
        shipped = docs.sparkSession.sparkContext.broadcast(build_index(items, q, edit_rate))

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            hit = {row for row, *_ in scan(shipped.value, [t or "" for t in texts])}
            return pd.Series([row not in hit for row in range(len(texts))])

        return clean("text")

    for items in item_blocks(benchmark, block_chars):
        docs = docs.filter(free_of(items))
    return docs
