"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Phrases are words in a row inside a piece of text (no stop between them). Three passes over the texts:

1. Words are counted. A phrase is no more frequent than its words.
2. Pairs of frequent words are counted by their hash. A phrase is no more frequent than its leading pair.
3. Every place where a frequent pair starts is a suffix: up to ``LONGEST`` words, cut where a word or pair is infrequent.
   Equal suffixes of a pack of text are one with a weight. Suffixes are routed by language and leading two words to
   buckets of bounded size; a leading pair with more than ``HOT`` places is spread by all words of its suffixes.

In a bucket the suffixes are pointers into one array of word codes. A segment of pointers is split three ways by the code at
its depth, against the code of a pivot pointer; the equal part goes on one word deeper, up to ``LONGEST``, and its weight
is the count of the phrase read so far. Parts that weigh less than the least count are abandoned, but for spread
pairs, whose phrases are counted in several buckets and summed up. All segments of a bucket are split in one go of array
operations.

What is frequent reaches the tasks as a bitmap over hashes, of at most ``2 ** MAP_BITS`` bits; a hash that falls together
with a frequent one only costs work. Counts are exact: words are told apart by 64-bit codes, and words whose codes
are equal are found in the word counts and get another code.

A candidate is a phrase of two words or more with the least count. For each cut into two parts its score is
``floor(2000000 a / (l + r))``, from its count and those of the parts; the worst cut counts. Candidates inside a longer one
that has at least 0.8 of their count go.

Defined cases: a null text has no words; a null language is ``und``; a text without stops is cut at blanks into packs,
each looking ahead over the end; repeated rows count again; an empty table has no phrases; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodespark.llm.common import saved

LEAST, LONGEST, FIRST = 30, 4, 2000
#: Part of a candidate's count that a longer one must have to replace it, in hundredths.
COVERED = 80
SCORE_SCALE = 2_000_000
#: Bytes of text that a task looks at together.
PACK_BYTES = 8 << 20
#: Words per bucket of the pair counts and of the suffixes; places from which a leading pair is spread.
BUCKET_WORDS, HOT = 2_000_000, 250_000
#: A bitmap has 16 bits for each hash, up to this power of two.
MAP_BITS = 26
#: Words that may need a second code.
MOST_CLASHES = 10_000
#: Stands for the end of a piece; no byte of UTF-8.
STOP = b"\xff"
_FROM = bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_FROM, bytes(range(97, 123)) + STOP * 10)
_AHEAD = re.compile(rb"[ \t]*(?:[^ \t\xff]+[ \t]*){0,%d}" % (LONGEST - 1))


def _cut(data: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a folded text of about ``limit`` bytes, and how many of a part's last words only continue it."""
    at = 0
    while len(data) - at > limit:
        stop = data.rfind(STOP, at, at + limit)
        if stop > at:
            yield data[at:stop], 0
            at = stop + 1
            continue
        end = max(data.rfind(b" ", at + 1, at + limit), data.rfind(b"\t", at + 1, at + limit))
        if end < 0:
            ends = [i for i in (data.find(c, at + limit) for c in (b" ", b"\t", STOP)) if i >= 0]
            end = min(ends, default=len(data))
        ahead = _AHEAD.match(data, end).group()
        yield data[at:end] + ahead, len(ahead.split())
        at = end
    yield data[at:], 0


def packs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, bytes, int]]:
    """(language, folded text of many rows, last words that only continue) from batches (lang, text as bytes)."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part, ahead in _cut((text.as_py() or b"").translate(_FOLD), limit):
                if ahead:
                    yield lang, part, ahead
                    continue
                held[lang].append(part)
                size += len(part)
                if size > limit:
                    yield from ((name, STOP.join(parts), 0) for name, parts in held.items())
                    held.clear()
                    size = 0
    yield from ((name, STOP.join(parts), 0) for name, parts in held.items())


def numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a pack as numbers, 0 for a stop, and the words by number."""
    found: dict[bytes, int] = defaultdict()
    found.default_factory = found.__len__
    found[STOP]
    words = data.replace(STOP, b" " + STOP + b" ").split()
    return np.fromiter(map(found.__getitem__, words), np.int64, len(words)), list(found)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_code(word: bytes, clashing: frozenset[bytes], mask: int) -> int:
    return (xxhash.xxh64_intdigest(word + b" " if word in clashing else word, 42) & mask) or 1


def code_column(word: Column, clashing: list[str], mask: int) -> Column:
    """The same as :func:`word_code`."""
    word = F.when(word.isin(clashing), F.concat(word, F.lit(" "))).otherwise(word) if clashing else word
    code = F.xxhash64(word).bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))
    return F.when(code == 0, F.lit(1).cast("long")).otherwise(code)


def _seed(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7)], dtype=np.uint64)


def _chain(seed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of a row of words from the hash of all but the last."""
    return mixed(seed * np.uint64(0x9E3779B97F4A7C15) + codes)


class Bitmap:
    """A set of 64-bit hashes by their leading bits; may hold more, never less."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame, most: int = MAP_BITS) -> Bitmap:
        """From a column ``hash``. The driver sees one number per 64 bits, at most ``2 ** (most - 6)``."""
        bits = min(most, max(10, (16 * hashes.count()).bit_length()))
        slot = F.shiftrightunsigned("hash", 64 - bits)
        one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")
        found = hashes.select(F.shiftright(slot, 6).alias("at"), one.alias("one")).groupBy("at").agg(F.bit_or("one").alias("word"))
        found = found.toArrow()
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        words[found["at"].to_numpy()] = found["word"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(bits, words)


def word_counts(texts: DataFrame, limit: int = PACK_BYTES) -> DataFrame:
    """(lang, word, n) of all words of (lang, text as bytes)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, ahead in packs(batches, limit):
            numbers, words = numbered(data)
            n = np.bincount(numbers[: len(numbers) - ahead], minlength=len(words))[1:]
            some = np.flatnonzero(n)
            found = pa.array([words[i + 1] for i in some.tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), found, pa.array(n[some])], names=["lang", "word", "n"])

    return texts.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Reader:
    """What a task needs to turn a pack into codes, with infrequent words as stops."""

    def __init__(self, clashing: list[str], mask: int, words: Bitmap):
        self.clashing, self.mask, self.words = frozenset(w.encode() for w in clashing), mask, words

    def read(self, lang: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, codes by number): frequent words count from 1, all else is 0."""
        numbers, words = numbered(data)
        codes = np.array([0] + [word_code(w, self.clashing, self.mask) for w in words[1:]], dtype=np.uint64)
        often = self.words.has(_chain(_seed(lang), codes))
        often[0] = False
        again = np.cumsum(often) * often
        return again[numbers], np.concatenate([np.zeros(1, np.uint64), codes[often]])


def _buckets(words: int, each: int) -> int:
    """Bits of the number of buckets."""
    return max(1, (-(-words // each) - 1).bit_length())


def pair_counts(texts: DataFrame, reader: _Reader, least: int, bits: int, limit: int = PACK_BYTES) -> DataFrame:
    """(hash, n) of the hashes of leading pairs of frequent words, from ``least`` on."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, ahead in packs(batches, limit):
            numbers, codes = reader.read(lang, data)
            first, second = numbers[:-1], numbers[1:]
            here = (first > 0) & (second > 0)
            if ahead:
                here[len(here) + 1 - ahead :] = False
            keys, n = np.unique(first[here] * len(codes) + second[here], return_counts=True)
            hashes = _chain(_chain(_seed(lang), codes[keys // len(codes)]), codes[keys % len(codes)])
            order = np.argsort(hashes)
            hashes, n = hashes[order], n[order].astype(np.int32)
            edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            spans = [(b, edges[b], edges[b + 1]) for b in np.flatnonzero(np.diff(edges)).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, *_ in spans], pa.int32()),
                    pa.array([hashes[i:j].tobytes() for _, i, j in spans], pa.binary()),
                    pa.array([n[i:j].tobytes() for _, i, j in spans], pa.binary()),
                ],
                names=["bucket", "hashes", "counts"],
            )

    def summed(group: pa.Table) -> pa.Table:
        hashes, n = _joined(group["hashes"], np.uint64), _joined(group["counts"], np.int32)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        total = np.add.reduceat(n[order].astype(np.int64), starts)
        often = total >= least
        return pa.table({"hash": hashes[starts][often].view(np.int64), "n": total[often]})

    rows = texts.mapInArrow(paired, "bucket int, hashes binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(summed, "hash long, n long")


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype=dtype)


def _suffixes(
    numbers: np.ndarray, codes: np.ndarray, seed: np.ndarray, ahead: int, pairs: Bitmap, longest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows by number with 0 behind their end, weights, hash of the leading pair), equal windows once."""
    padded = np.concatenate([numbers, np.zeros(longest, np.int64)])
    own = codes[padded]
    first, second = padded[:-1], padded[1:]
    paired = (first > 0) & (second > 0)
    paired[paired] = pairs.has(_chain(_chain(seed, own[:-1][paired]), own[1:][paired]))
    starts = np.flatnonzero(paired[: len(numbers) - ahead])
    window = np.zeros((longest, len(starts)), dtype=np.int64)
    window[0], window[1] = padded[starts], padded[starts + 1]
    on = np.ones(len(starts), dtype=bool)
    for d in range(2, longest):
        on &= paired[starts + d - 1]
        window[d] = np.where(on, padded[starts + d], 0)
    if longest % 2:
        window = np.concatenate([window, np.zeros((1, len(starts)), np.int64)])
    keys = [window[d] << 32 | window[d + 1] for d in range(0, len(window), 2)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    kept = np.flatnonzero(new)
    window = window[:longest, order[kept]]
    weights = np.diff(np.append(kept, len(order)))
    return window, weights, _chain(_chain(seed, codes[window[0]]), codes[window[1]])


def frequent_prefixes(
    codes: np.ndarray, at: np.ndarray, lengths: np.ndarray, weights: np.ndarray, least: int, longest: int = LONGEST
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointer, depth, count) of the prefixes of two words or more that weigh at least ``least``.

    Multikey quicksort of the pointers ``at`` into ``codes``, of suffixes with the given lengths. ``order`` holds the
    pointers of all live segments, one segment behind the other.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.arange(len(at))
    sizes, depths = np.array([len(at)]), np.zeros(1, np.int64)
    while len(order):
        segment = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        depth = depths[segment]
        keys = codes[at[order] + depth]
        pivots = keys[starts + sizes // 2]
        side = np.where(keys == pivots[segment], 1, np.where(keys < pivots[segment], 0, 2))
        # Stable three-way split of each segment: the place of an element is its part's start plus its rank in the part.
        part = segment * 3 + side
        part_sizes = np.bincount(part, minlength=3 * len(sizes))
        part_starts = np.cumsum(part_sizes) - part_sizes
        place = np.empty(len(order), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            runs = part_sizes[s::3]
            place[mine] = np.arange(len(mine)) + np.repeat(part_starts[s::3] - (np.cumsum(runs) - runs), runs)
        split = np.empty_like(order)
        split[place] = order
        weighed = np.bincount(part, weights[order], minlength=3 * len(sizes)).astype(np.int64)
        deeper = np.repeat(depths, 3) + np.tile([0, 1, 0], len(sizes))
        live = (part_sizes > 0) & (weighed >= least)
        equal = live & (np.arange(len(live)) % 3 == 1)
        told = np.flatnonzero(equal & (deeper >= 2))
        out.append((split[part_starts[told]], deeper[told], weighed[told]))
        live &= deeper < longest
        keep = np.repeat(live, part_sizes)
        owner = np.repeat(np.arange(len(live)), part_sizes)[keep]
        order = split[keep]
        # Suffixes that end at the depth reached have nothing left to compare.
        going = lengths[order] > deeper[owner]
        order, owner = order[going], owner[going]
        sizes = np.bincount(owner, minlength=len(live))
        live = sizes > 0
        # A segment that lost too much weight to ended suffixes is abandoned too.
        live &= np.bincount(owner, weights[order], minlength=len(live)) >= least
        order = order[live[owner]]
        sizes, depths = sizes[live], deeper[live]
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def phrase_counts(
    texts: DataFrame, reader: _Reader, pairs: Bitmap, hot: Bitmap | None, least: int, longest: int, bits: int, limit: int = PACK_BYTES
) -> DataFrame:
    """(lang, w0, w1, ..., n): the codes of the words of each phrase, null behind its end, and its count."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, ahead in packs(batches, limit):
            numbers, codes = reader.read(lang, data)
            window, weights, route = _suffixes(numbers, codes, _seed(lang), ahead, pairs, longest)
            spread = hot.has(route) if hot is not None else np.zeros(len(route), bool)
            whole = route
            for d in range(2, longest):
                whole = _chain(whole, codes[window[d]])
            target = np.where(spread, whole, route) >> np.uint64(64 - bits) << np.uint64(1) | spread.astype(np.uint64)
            order = np.argsort(target, kind="stable")
            target, window, weights = target[order], window[:, order], weights[order].astype(np.int32)
            lengths = (window > 0).sum(axis=0).astype(np.uint8)
            edges = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]])) if len(target) else np.zeros(1, int)
            rows = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = window[:, i:j].T
                tokens = codes[part[part > 0]]
                rows.append((int(target[i]) >> 1, bool(target[i] & np.uint64(1)), lengths[i:j].tobytes(), tokens.tobytes(), weights[i:j].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(rows), pa.string()),
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.bool_()),
                    *[pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3, 4)],
                ],
                names=["lang", "bucket", "spread", "lengths", "tokens", "weights"],
            )

    names = [f"w{d}" for d in range(longest)]
    schema = "lang string, spread boolean, " + ", ".join(f"{w} long" for w in names) + ", n long"

    def counted(key: tuple, group: pa.Table) -> pa.Table:
        lang, _, spread = (k.as_py() for k in key)
        lengths = _joined(group["lengths"], np.uint8).astype(np.int64)
        tokens = _joined(group["tokens"], np.uint64)
        weights = _joined(group["weights"], np.int32).astype(np.float64)
        at = np.cumsum(lengths) - lengths
        pointer, depth, n = frequent_prefixes(tokens, at, lengths, weights, 1 if spread else least, longest)
        columns = {}
        for d, name in enumerate(names):
            on = depth > d
            codes = tokens[at[pointer[on]] + d].view(np.int64)
            values = np.zeros(len(pointer), np.int64)
            values[on] = codes
            columns[name] = pa.array(values, mask=~on)
        size = len(pointer)
        return pa.table({"lang": pa.array([lang] * size, pa.string()), "spread": pa.array([spread] * size, pa.bool_()), **columns, "n": pa.array(n, pa.int64())})

    rows = texts.mapInArrow(routed, "lang string, bucket int, spread boolean, lengths binary, tokens binary, weights binary")
    found = saved(rows.groupBy("lang", "bucket", "spread").applyInArrow(counted, schema), "phrase-counts")
    parts = found.filter("spread").groupBy("lang", *names).agg(F.sum("n").alias("n"))
    return found.filter("not spread").drop("spread").union(parts.filter(F.col("n") >= least))


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seeds = np.concatenate([np.zeros(0, np.uint64), *map(_seed, batch.column(0).to_pylist())])
        codes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(_chain(seeds, codes).view(np.int64))], names=["hash"])


def all_counts(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    bucket_words: int = BUCKET_WORDS,
    hot: int = HOT,
    limit: int = PACK_BYTES,
    mask: int = (1 << 64) - 1,
) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases and words from ``least`` on, (lang, n) words of each language); saved."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = saved(word_counts(texts, limit), "word-counts")
    per_lang = saved(counted.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")
    total = per_lang.agg(F.sum("n")).first()[0] or 0
    coded = counted.withColumn("code", code_column(F.col("word"), [], mask))
    clashes = coded.groupBy("code").agg(F.min("word").alias("low"), F.max("word").alias("high")).filter("low <> high")
    told = coded.join(clashes.select("code"), "code").select("word").distinct().limit(MOST_CLASHES + 1).collect()
    clashing = sorted(r["word"] for r in told)
    if len(clashing) > MOST_CLASHES:
        raise ValueError("too many words share codes")
    words = counted.filter(F.col("n") >= least).withColumn("code", code_column(F.col("word"), clashing, mask))
    words = saved(words, "frequent-words")
    if clashing:
        codes = counted.select(code_column(F.col("word"), clashing, mask).alias("code"), "word").groupBy("code")
        if codes.agg(F.min("word").alias("low"), F.max("word").alias("high")).filter("low <> high").limit(1).count():
            raise ValueError("words share their second code too")

    reader = _Reader(clashing, mask, Bitmap.of(words.select("lang", "code").mapInArrow(_hashed_words, "hash long")))
    bits = _buckets(total, bucket_words)
    pairs = saved(pair_counts(texts, reader, least, bits, limit), "frequent-pairs")
    hot_pairs = pairs.filter(F.col("n") >= hot).select("hash")
    spread = Bitmap.of(hot_pairs) if hot_pairs.limit(1).count() else None
    found = phrase_counts(texts, reader, Bitmap.of(pairs), spread, least, longest, bits, limit)

    names = [f"w{d}" for d in range(longest)]
    for name in names:
        one = words.select(F.col("lang").alias("__lang"), F.col("code").alias("__code"), F.col("word").alias(f"{name}_word"))
        found = found.join(one, (F.col("lang") == F.col("__lang")) & (F.col(name) == F.col("__code")), "left").drop("__lang", "__code")
    spelled = F.filter(F.array(*[F.col(f"{w}_word") for w in names]), lambda w: w.isNotNull())
    singles = words.select("lang", F.array("word").alias("words"), F.col("n").alias("f"))
    both = found.select("lang", spelled.alias("words"), F.col("n").alias("f")).union(singles)
    return saved(both.withColumn("phrase", F.array_join("words", " ")), "all-phrases"), per_lang


def _parts(words: Column, size: Column, pick: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), size - 1), pick)


def scored(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers."""
    words, size = F.col("words"), F.size("words")
    several = counts.filter(size > 1)

    def cut(k: Column) -> Column:
        return F.struct(
            k.alias("k"),
            F.array_join(F.slice(words, 1, k), " ").alias("first"),
            F.array_join(F.slice(words, k + 1, size - k), " ").alias("rest"),
        )

    cuts = several.select("lang", "phrase", F.col("f").alias("a"), F.explode(_parts(words, size, cut)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(cast(a as decimal(19,0)) * {SCORE_SCALE}) div (cast(l as decimal(19,0)) + r)")
    worst = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst"))
    )

    def inner(length: Column) -> Column:
        starts = F.sequence(F.lit(1), size - length + 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))

    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), inner))
    covers = (
        counts.filter(size > 2)
        .select("lang", F.explode(inside).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    apart = F.coalesce(F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * covered, F.lit(True))
    return worst.join(covers, ["lang", "phrase"], "left").filter(apart).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")


def collocations(docs: DataFrame, first: int = FIRST, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``first`` phrases of each language."""
    counts, per_lang = all_counts(docs, **limits)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranks = scored(counts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= first)
    return ranks.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
