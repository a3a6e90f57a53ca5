"""Mixing, resharding, the archive, the license scan and the pipeline."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodespark.llm import decontamination, license_scan, mixing, near_copies, queries, resharding, warc
from lodespark.llm.common import table
from tests.llm.conftest import SF
from tests.llm.test_near_copies import least_ids


def filled(sizes, weights, cap=3):
    """Targets by resharing the excess until none is above its cap."""
    total, open_, out = sum(sizes), list(range(len(sizes))), {}
    while open_:
        left = total - sum(out.values())
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = [i for i in open_ if share[i] > cap * sizes[i]]
        if not full:
            out.update(share)
            break
        out.update({i: cap * sizes[i] for i in full})
        open_ = [i for i in open_ if i not in full]
    return [out[i] for i in range(len(sizes))]


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 40, 1000]) for _ in range(rng.randrange(1, 9))]
        rows = spark.createDataFrame([(f"v{i}", s) for i, s in enumerate(sizes)], "source_key string, size long")
        got = {r["source_key"]: r["target"] for r in mixing.targets(rows).collect()}
        want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert [got[f"v{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_takes_budgets_exactly(spark, odd, odd_rows, empty):
    rows = mixing.mix(odd, bucket_rows=2).collect()
    assert len(rows) == len(odd_rows)
    words = Counter(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in odd_rows)
    assert Counter(r["size"] for r in rows) == words
    for source in {r["source_key"] for r in rows}:
        mine = [r for r in rows if r["source_key"] == source]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 0.5)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.mix(odd.repartition(7), bucket_rows=5).collect()
    pick = lambda rs: sorted(str((r["doc_id"], r["source_key"], r["size"], r["taken"])) for r in rs)
    assert pick(again) == pick(rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns


def test_mixed_rows_follow_the_mix(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix(docs).collect()
    taken, got = Counter(), Counter()
    target, largest = {}, Counter()
    for r in rows:
        target[r["source_key"]] = r["target"]
        largest[r["source_key"]] = max(largest[r["source_key"]], r["size"])
    for r in mixing.mixed_rows(docs).select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")).collect():
        taken["v" + r["source"]] += r["n"]
        got[r["doc_id"]] += 1
    assert max(got.values()) <= 3
    for source, words in taken.items():
        assert abs(words - target[source]) <= largest[source]


def test_mix_of_many_equal_rows(spark, monkeypatch):
    """Rows without id and with one text are counted, and written out in chunks."""
    rows = [(None, "hot", "one two three")] * 900 + [(None, "hot", f"word {i}") for i in range(60)]
    rows += [(7, "hot", "w " * (i % 5)) for i in range(200)] + [(i, "b", "a b c d") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    want = None
    for chunk in (1 << 16, 16):
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        got = mixing.mix(docs, bucket_rows=50).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, _, t in rows)
        for source in ("vhot", "vb"):
            mine = [r for r in got if r["source_key"] == source]
            assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 0.5)
            assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
            ends = sorted((r["before"], r["before"] + r["size"]) for r in mine if r["size"])
            assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        here = Counter((r["doc_id"], r["size"], r["before"], r["taken"]) for r in got)
        want = want or here
        assert here == want


def least_cost(supply, capacity, cost):
    """Smallest cost by trying every way to place unit after unit."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    best = None
    for choice in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(choice.count(j) <= capacity[j] for j in range(len(capacity))):
            paid = sum(cost[i, j] for i, j in zip(units, choice))
            best = paid if best is None else min(best, paid)
    return best


def test_flow_has_least_cost():
    rng = np.random.default_rng(7)
    for _ in range(40):
        n, m = rng.integers(1, 4, 2)
        supply = rng.integers(0, 3, n).tolist()
        capacity = rng.integers(0, 3, m).tolist()
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = rng.integers(0, 6, (n, m)).astype(float)
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= capacity[k] for k in range(m))
        assert sum(cost[e] * f for e, f in flow.items()) == least_cost(supply, capacity, cost)
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [2], np.zeros((1, 1)))


def test_reshard_is_even_and_moves_little(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "source")
    old = F.pmod(F.crc32("source"), F.lit(8)).cast("int")
    rows = resharding.reshard(docs.withColumn("shard", old), F.col("shard"), shards=10)
    assert rows.columns == ["doc_id", "text", "source", "shard", "slot"]
    sized = rows.select("doc_id", "shard", "slot", old.alias("old"), resharding.row_size(F.col("text")).alias("size")).collect()
    assert len(sized) == docs.count() and len({r["doc_id"] for r in sized}) == len(sized)
    total, largest = Counter(), max(r["size"] for r in sized)
    for r in sized:
        total[r["shard"]] += r["size"]
    even = sum(total.values()) / 10
    assert set(total) == set(range(10)) and max(abs(t - even) for t in total.values()) <= 2 * largest
    for shard in total:
        assert sorted(r["slot"] for r in sized if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in sized)))
    before = Counter()
    for r in sized:
        before[r["old"]] += r["size"]
    least = sum(max(0, b - even) for b in before.values())
    assert sum(r["size"] for r in sized if r["old"] != r["shard"]) <= least + 8 * largest


def test_equal_rows_spread_over_the_shards(spark):
    """Equal rows are dealt one by one, beside others and from two old shards; the layout is the same every time."""
    alone = spark.createDataFrame([(None, "the same text")] * 2000, "doc_id long, text string").repartition(4)
    rows = resharding.reshard(alone, F.lit(3), shards=40).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and set(counts.values()) <= {49, 50, 51}
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s, n in counts.items() for i in range(n)}

    mixed = [(None, "hot text", i % 2) for i in range(900)] + [(i, "text " * (i % 7), 2) for i in range(900)]
    frame = spark.createDataFrame(mixed, "doc_id long, text string, old int")
    layouts = []
    for parts in (3, 7):
        got = resharding.reshard(frame.repartition(parts), F.col("old"), shards=8).collect()
        layouts.append(Counter((r["doc_id"], r["text"], r["old"], r["shard"], r["slot"]) for r in got))
        size = Counter()
        for r in got:
            size[r["shard"]] += len(r["text"]) + 16
        assert max(size.values()) - min(size.values()) <= 4 * (30 + 16)
        assert Counter((r["doc_id"], r["text"], r["old"]) for r in got) == Counter(mixed)
    assert layouts[0] == layouts[1]


def test_untouched_shards_are_not_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 84, i % 2) for i in range(40)], "doc_id long, text string, old int")
    even = resharding.reshard(docs, F.col("old"), str(tmp_path / "even"), shards=2)
    assert not list((tmp_path / "even").glob("shard=*")) and even.filter("shard <> old").count() == 0
    some = resharding.reshard(docs, F.col("old"), str(tmp_path / "some"), shards=3, capacities=[2000, 1000, 1000])
    assert sorted(p.name for p in (tmp_path / "some").glob("shard=*")) == ["shard=1", "shard=2"]
    assert {(r["shard"], r["count"]) for r in some.groupBy("shard").count().collect()} == {(0, 20), (1, 10), (2, 10)}


def test_reshard_odd_rows(spark, odd, odd_rows, empty):
    got = resharding.reshard(odd, F.pmod(F.xxhash64("source"), F.lit(5)), shards=4)
    assert got.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    rows = got.collect()
    assert Counter(r["text"] for r in rows) == Counter(r[1] for r in odd_rows)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert resharding.reshard(empty, F.lit(0)).count() == 0


def test_reshard_query(spark):
    rows = queries.op8_reshard(spark, SF).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in table(spark, SF, "documents").collect()}
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        assert r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["grown_shard"] is None


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (5, "http://a/5", "<p>same</p>"),
    (2, "http://a/2", None), (4, "x\r\ny", ""), (6, "http://b", "é\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"),
    (None, "http://c", "no id"), (None, "http://c", "<p>same</p>"), (9, "http://d", "z" * 500_000),
]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "h") for p in PAGES], "page_id long, url string, html string, id int, head string")
    warc.write_archive(pages, str(tmp_path))
    payloads = [r["payload"] for r in spark.read.parquet(f"{tmp_path}/payloads").collect()]
    assert Counter(bytes(p) for p in payloads) == Counter({(p[2] or "").encode() for p in PAGES})
    records = warc.read_archive(spark, str(tmp_path))
    for r in records.collect():
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        assert len(block) - 4 == int(fields["Content-Length"])
        http, payload = block[:-4].split(b"\r\n\r\n", 1)
        want = {(p[2] or "").encode() for p in PAGES if p[0] == r["id"]}
        assert (payload in want) if fields["WARC-Type"] == "response" else payload == b""
    facts = warc.record_facts(records).collect()
    got = Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in facts)
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        keeper = max((p[0] for p in PAGES if (p[2] or "").encode() == data and p[0] is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kept = i == keeper
        want[i, len(data), digest, "response" if kept else "revisit", None if kept else keeper] += 1
    assert got == want


def test_archive_of_small_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a", min_bytes=4)
    types = [r["record_type"] for r in warc.record_facts(warc.read_archive(spark, f"{tmp_path}/a")).collect()]
    assert types == ["response", "response"]
    warc.write_archive(pages.limit(0), f"{tmp_path}/b")
    assert warc.record_facts(warc.read_archive(spark, f"{tmp_path}/b")).count() == 0


def test_changed_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path))
    records = warc.read_archive(spark, str(tmp_path)).withColumn("record", F.regexp_replace(F.decode("record", "UTF-8"), "abc", "abd").cast("binary"))
    with pytest.raises(Exception, match="does not match"):
        warc.record_facts(records).collect()


def test_license_inheritance(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License"), ("a/x.py", "print"), ("a/b/c/y.py", "hello"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0"),
        ("a/z.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code here " * 50), ("q/w.py", "no licence of mine"), ("top", None), (None, ""),
        ("ab/x", "x"),
    ]
    frame = spark.createDataFrame([(i, p, t, "c") for i, (p, t) in enumerate(files)], "doc_id long, at string, text string, license string")
    got = {r["doc_id"]: (r["own_license"], r["license_file"], r["license"], r["license_from"]) for r in license_scan.scan(frame, F.col("at")).collect()}
    assert got == {
        0: ("MIT", True, "MIT", None), 1: (None, False, "MIT", "a"), 2: (None, False, "Apache-2.0", "a/b"), 3: ("Apache-2.0", True, "Apache-2.0", None),
        4: ("GPL-3.0", False, "GPL-3.0", None), 5: (None, False, None, None), 6: (None, False, None, None), 7: (None, False, None, None), 8: (None, False, None, None),
    }


def test_license_odd_rows(spark, odd, odd_rows, empty):
    got = license_scan.scan(odd, F.concat_ws("/", "source", "doc_id"))
    assert got.count() == len(odd_rows) and got.columns.count("path") == 1
    assert {r["doc_id"]: r["own_license"] for r in got.collect()}[13] == "MIT"
    assert license_scan.scan(empty, F.col("path")).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    staged, rows = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).cache()
        staged[name] = rows.collect()
        if name != "sharding":
            assert rows.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(staged["language_id"]) == len(texts)
    firsts = least_ids(texts, near_copies.SIMILARITY)
    assert sorted(r["doc_id"] for r in staged["near_dedup"]) == firsts and len(firsts) < len(texts)
    items = [decontamination.normalised(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = [i for i in firsts if not any(x in decontamination.normalised(texts[i]) for x in items)]
    assert sorted(r["doc_id"] for r in staged["decontamination"]) == clean
    assert Counter(r["doc_id"] for r in staged["sharding"]) == Counter(r["doc_id"] for r in staged["mixing"])
    assert {r["doc_id"] for r in staged["mixing"]} <= set(clean)
    assert all(r["text"] == texts[r["doc_id"]] for r in staged["sharding"])
    ran = corpus_pipeline.run(spark, SF)
    pick = lambda rs: Counter((r["doc_id"], r["shard"], r["slot"]) for r in rs)
    assert pick(ran.collect()) == pick(staged["sharding"])


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, "nothing of this kind is anywhere")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for rows in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
        assert "slot" in rows.columns and rows.count() >= 0
