"""Components, SimHash near-duplicates, decontamination and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodespark.llm import decontamination, neighbours, simhash
from lodespark.llm.common import table
from lodespark.llm.components import components
from tests.llm.conftest import SF, prose


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in linked:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def same_partition(left, right):
    return len(set(left.items())) == len(left) and len({(left[n], right[n]) for n in left}) == len(
        set(left.values())
    ) == len(set(right.values()))


def test_components_of_paths_stars_and_cliques(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(201, 200), (200, 201), (7, 7)]
    links += [(a, b) for a in range(300, 312) for b in range(300, a)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components({n for ab in links for n in ab}, links)
    assert got.keys() == want.keys() and same_partition(got, want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unsigned(fp):
    return fp % (1 << 64)


@pytest.mark.parametrize("blocks", [simhash.NARROW, simhash.WIDE])
@pytest.mark.parametrize("threshold", [3, 4])
def test_every_link_is_met(spark, blocks, threshold):
    """Random fingerprints and copies with up to six flipped bits, many in each block."""
    rng = random.Random(5)
    prints = set()
    for _ in range(120):
        base = rng.getrandbits(64)
        prints.add(base)
        for flips in (1, 2, 3, 4, 4, 4, 5, 6):
            low, high = rng.choice([(0, 64), (0, 23), (23, 46), (46, 64), (0, 46), (0, 32), (32, 64)])
            bits = rng.sample(range(low, high), flips)
            prints.add(base ^ sum(1 << b for b in bits))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {tuple(r) for r in simhash.cell_links(frame, threshold, blocks).collect()}
    node = simhash.node(F.col("fp"), blocks, threshold)
    nodes = {unsigned(r["fp"]): r["node"] for r in frame.withColumn("node", node).collect()}
    want, close = set(), 0
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            apart = (a ^ b).bit_count()
            if nodes[a] == nodes[b]:
                assert apart <= threshold
            elif apart <= threshold:
                close += 1
                want.add((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
    assert close > 300 and got == want


def test_near_duplicates_match_brute_force(spark, odd, odd_rows, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    texts = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    prints = {plain_fingerprint(r[1]) for r in odd_rows}
    linked = [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 4]
    group = plain_components(prints, linked)
    for r in got:
        assert r["doc_id"] is None or unsigned(r["fp"]) == plain_fingerprint(texts[r["doc_id"]])
        mates = [i for i, t in texts.items() if group[plain_fingerprint(t)] == group[unsigned(r["fp"])]]
        assert r["component_id"] == min(mates, default=None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(group.values()))
    assert simhash.one_of_each(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.cell_links(odd.select("fp"), threshold=5)


def edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def mutated(text, n, rng):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcxyz")
        elif kind == 1:
            chars.insert(at, rng.choice("abcxyz"))
        else:
            del chars[at]
    return "".join(chars)


def test_contamination_matches_brute_force():
    rng = random.Random(3)
    items = [(i, prose(i, 6 + 4 * i).title()) for i in range(8)] + [(8, "short"), (9, None), (10, prose(2, 14)), (11, "a" * 60)]
    index = decontamination.build_index(items)
    texts = ["", "nothing of it", "b" * 300, "a" * 70]
    for i, item in items[:8]:
        for n in (0, 1, len(item) // 20, len(item) // 10, len(item) // 8, len(item) // 5):
            texts.append(prose(50 + i, 20) + "  \n" + mutated(item, n, rng) + "\t" + prose(70 + i, 9))
    texts += [mutated(items[3][1], 2, rng), items[5][1][:-3], items[5][1][4:] + " x"]
    got = {(row, index.texts[it]): e for row, it, e, *_ in decontamination.scan(index, texts)}
    for row, text in enumerate(texts):
        for k, norm in enumerate(index.texts):
            least = edits(norm, decontamination.normalised(text))
            assert got.get((row, norm)) == (least if least <= index.budget[k] else None), (row, norm, least)
    for row, it, e, start, end in decontamination.scan(index, texts):
        part = decontamination.normalised(texts[row])[start:end]
        assert edits(part, index.texts[it]) <= e + abs(len(part) - len(index.texts[it]))


def test_windows_and_blocks(spark, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(6)]
    text = prose(90, 300) + " " + items[4][1] + " " + prose(91, 300) + " " + items[1][1]
    whole = sorted(decontamination.scan(decontamination.build_index(items), [text, "x"]))
    monkeypatch.setattr(decontamination, "WINDOW", 700)
    assert sorted(decontamination.scan(decontamination.build_index(items), [text, "x"])) == whole and len(whole) == 2
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs, bench, block_chars=200).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (1, 4)]
    assert [r["doc_id"] for r in decontamination.decontaminated(docs, bench, block_chars=200).collect()] == [2]


def test_contamination_odd_rows(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame(
        [(1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (None, prose(2, 30))], "item_id long, text string"
    )
    got = sorted(str((r["doc_id"], r["item_id"])) for r in decontamination.contaminated(odd, bench).collect())
    assert got == sorted([str((d, i)) for d in (6, 6, 6, 7) for i in (1, 2)] + ["(12, None)"])
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0
    assert decontamination.decontaminated(odd, bench).count() == len(odd_rows) - 5


def test_whole_items_of_the_table_are_found(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    items = [(r["item_id"], decontamination.normalised(r["text"])) for r in bench.collect()]
    texts = [(r["doc_id"], decontamination.normalised(r["text"])) for r in docs.collect()]
    whole = {(d, i) for d, t in texts for i, item in items if item in t}
    assert whole and whole == found


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, rank int")


def plain_nearest(rows, k):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = np.array(v, dtype=np.float32).astype(float)
    out = []
    for q in (i for i in usable if i % 100 == 0):
        far = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)
        out += [(q, rank + 1, i) for rank, (_, i) in enumerate(far[:k])]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    """Ties, copies, repeated rows and rows that take no part."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist(), 0, 1, 2) for i in range(0, 300, 5)]
    rows += [(1000 + i, rows[0][1], 0, 1, 2) for i in range(30)] + [rows[0], rows[20]]
    rows += [(400, None, 0, 1, 2), (401, [0.0] * 12, 0, 1, 2), (402, [None] + [1.0] * 11, 0, 1, 2)]
    rows += [(500, [float("nan")] * 12, 0, 1, 2), (600, [float("inf")] * 12, 0, 1, 2), (700, [1.0], 0, 1, 2), (None, [1.0] * 12, 0, 1, 2)]
    got = neighbours.nearest(vectors(spark, rows), F.col("id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(plain_nearest(rows, 10))
    few = neighbours.nearest(vectors(spark, rows[:3]), F.col("id") % 100 == 0).collect()
    assert len(few) == 2
    assert neighbours.nearest(vectors(spark, []), F.col("id") % 100 == 0).count() == 0
    assert neighbours.nearest(vectors(spark, rows[:1]), F.col("id") % 100 == 0).count() == 0


def test_recall(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = neighbours.nearest(rows, F.col("id") % 100 == 0).collect()
    matrix = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows.collect()}
    ids, all_of = np.array(list(matrix)), np.stack(list(matrix.values()))
    hit = 0
    for q in {r["query_id"] for r in got}:
        far = np.sqrt(((all_of - matrix[q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, far))] if i != q][:10]
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        hit += len(set(best) & mine.keys())
        assert all(abs(np.sqrt(((matrix[i] - matrix[q]) ** 2).sum()) - s) < 1e-12 for i, s in mine.items())
    assert hit / len(got) >= 0.9


@pytest.mark.parametrize("jitter, offset", [(0.0003, 0.0), (0.02, 100.0)])
def test_recall_of_near_copies_and_of_an_offset_component(spark, jitter, offset):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(2, 64)) / 8
    matrix = centres[np.arange(1200) % 2] + rng.normal(size=(1200, 64)) * jitter
    matrix[:, 0] += offset
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(frame, F.col("id") % 40 == 0).collect()}
    want = set()
    for q in range(0, 1200, 40):
        far = ((matrix - matrix[q]) ** 2).sum(axis=1)
        want |= {(q, int(i)) for i in np.argsort(far) if i != q and far[i] <= np.sort(far)[10]}
    assert len(got & want) >= 0.9 * len(want)


def test_ranges_stay_even_and_windows_find_the_nearest():
    """A third near copies, or a few vectors far out, change no range; the window comes from what the sample finds."""
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(12_000, 24))
    dense, far = plain.copy(), plain.copy()
    dense[:4000] = plain[0] + 1e-4 * rng.normal(size=(4000, 24))
    far[:20] *= 1e4
    for rows in (plain, dense, far):
        model = neighbours.fit(rows, len(rows), curves=8)
        at = [model.ranges(rows, c) for c in range(8)]
        mean = len(rows) / (len(model.ends[0]) + 1)
        assert max(np.bincount(a).max() for a in at) <= 2 * mean
        probes = rng.choice(len(rows), 60, replace=False)
        hit = 0
        for p in probes:
            gap = ((rows - rows[p]) ** 2).sum(axis=1)
            gap[p] = np.inf
            best = np.argsort(gap)[:10]
            hit += sum(any(abs(int(a[i]) - int(a[p])) <= model.beside for a in at) for i in best)
        assert hit / 600 >= 0.9
    fixed = neighbours.fit(plain, len(plain), curves=2, window=2.0)
    assert len(fixed.ends[0]) + 1 == round(12_000 / (2 * 12_000**0.5))
    few = neighbours.fit(plain, 10_000_000, curves=2, window=40.0)
    assert few.beside == 7 and len(few.ends[0]) + 1 <= 500


def test_an_id_with_two_vectors_has_the_smaller(spark):
    rows = [(0, [1.0, 0.0], 0, 1, 2), (1, [2.0, 0.0], 0, 1, 2), (1, [5.0, 0.0], 0, 1, 2), (1, None, 0, 1, 2)]
    got = neighbours.nearest(vectors(spark, rows), F.col("id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0)]


def test_hilbert_order_is_a_curve():
    """All cells once, neighbours differ by one step in one dimension."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
