"""Collocations against counters over all places."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodespark.llm import collocations, queries
from lodespark.llm.common import table
from tests.llm.conftest import SF

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, first=2000):
    """rows: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found, covered = [], {}
        for p, c in counts.items():
            if len(p) > 2 and c >= least:
                for size in range(2, len(p)):
                    for i in range(len(p) - size + 1):
                        covered[p[i : i + size]] = max(covered.get(p[i : i + size], 0), c)
        for p, a in counts.items():
            if len(p) < 2 or a < least or 100 * covered.get(p, 0) >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


def corpus(seed, rows):
    """Few words, so that many phrases are frequent; one pair of words makes up a third."""
    rng = random.Random(seed)
    words = ["of", "The", "é", "sea", "salt\tlake", "x-y", "ÉA", "to", "😀", "in"]
    out = []
    for i in range(rows):
        text = "".join(rng.choice(["of the ", rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n", "\x0b", "!"]), "old salt sea "]) for _ in range(rng.randrange(60)))
        out.append((rng.choice([None, "en", "en", "en", "de", "und"]), text))
    return out


@pytest.mark.parametrize("limits", [{}, {"limit": 200, "bucket_words": 300, "hot": 50}, {"mask": (1 << 8) - 1, "hot": 60}])
def test_matches_counters(spark, limits):
    """Also with small packs, many buckets, spread pairs, and codes of eight bits, some of which clash."""
    rows = corpus(5, 400)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = plain(rows)
    assert len(want) > 60 and told(collocations.collocations(frame, **limits)) == want
    assert told(collocations.collocations(frame, first=7, **limits)) == plain(rows, first=7)


def test_text_without_stops(spark):
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(3000)) + " " + "z" * 500)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert told(collocations.collocations(frame, limit=100)) == plain(rows)


def test_cut_is_whole():
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"ab \t\xff") for _ in range(rng.randrange(120)))
        starts, pieces = [], [p.split() for p in data.split(b"\xff")]
        want = Counter((tuple(p[i : i + 4])) for p in pieces for i in range(len(p)))
        for part, ahead in collocations._cut(data, 15):
            words = [p.split() for p in part.split(b"\xff")]
            flat = [(p, i) for p in words for i in range(len(p))]
            starts += [tuple(p[i : i + 4]) for p, i in flat[: len(flat) - ahead]]
        assert Counter(starts) == want


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(6)
    for least in (1, 3, 20):
        lengths = rng.integers(2, 5, 900)
        at = np.cumsum(lengths) - lengths
        codes = rng.zipf(1.7, lengths.sum()).astype(np.uint64) % np.uint64(9) + np.uint64(1)
        weights = rng.integers(1, 4, 900).astype(float)
        want = Counter()
        for p, size, w in zip(at, lengths, weights):
            for d in range(2, size + 1):
                want[tuple(codes[p : p + d].tolist())] += int(w)
        pointer, depth, n = collocations.frequent_prefixes(codes, at, lengths, weights, least)
        got = {tuple(codes[at[p] : at[p] + d].tolist()): c for p, d, c in zip(pointer, depth, n)}
        assert len(got) == len(n) and got == {k: v for k, v in want.items() if v >= least}


def test_collocations_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("lang", "text").collect()]
    assert told(queries.op12_collocations(spark, SF)) == plain(rows)


def test_collocations_odd_rows(spark, odd, odd_rows, empty):
    rows = [(r[2], r[1]) for r in odd_rows]
    assert told(collocations.collocations(odd)) == plain(rows)
    assert collocations.collocations(empty).count() == 0
