"""The Merkle manifest against a plain tree, and chat formatting against a plain renderer and its round trip."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodespark.llm import chat, merkle, queries
from lodespark.llm.common import table
from tests.llm.conftest import SF


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, fanout):
    """(root, proofs): each proof is a list of (before, after)."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for leaf, place in enumerate(at):
            run, i = runs[place // fanout], place % fanout
            proofs[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            at[leaf] = place // fanout
        nodes = [sha(*run) for run in runs]
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    """rows: (tree, id, leaf) -> {(tree, id, leaf): set of (subroot, root, steps)}."""
    trees = {}
    for tree, key, leaf in rows:
        trees.setdefault(tree, []).append((key, leaf))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subs = {}
    for t in names:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[t] = plain_tree([leaf for _, leaf in trees[t]], fanout)
    root, tops = plain_tree([subs[t][0] for t in names], fanout)
    out = []
    for t, top in zip(names, tops):
        for (key, leaf), steps in zip(trees[t], subs[t][1]):
            out.append((str((t, key)), leaf, subs[t][0], root, str(steps + top)))
    return sorted(out)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 2), (3, 1), (2, 10)])
def test_manifest_matches_plain_tree(spark, fanout, levels):
    rng = random.Random(fanout * 10 + levels)
    sizes = {"a": 1, "b": 2, None: 5, "é": 9, "z": 37, "": 8}
    rows = [(t, rng.choice([None, 1, i]) if t == "z" else i, sha(str(t), str(rng.randrange(30)))) for t, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "tree string, id long, leaf string").withColumn("row", F.struct("id"))
    got = merkle.manifest(frame.repartition(3), fanout, levels, range_rows=11)
    got = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
    assert all(r["folded"] == r["root"] for r in got)
    steps = lambda r: str([(s["before"], s["after"]) for s in r["steps"]])
    told = sorted((str((r["tree"], r["row"]["id"])), r["leaf"], r["subroot"], r["root"], steps(r)) for r in got)
    assert told == plain_manifest(rows, fanout)


def test_manifest_query(spark):
    docs = table(spark, SF, "documents").collect()
    leaf = {d["doc_id"]: sha(*[field(d[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]) for d in docs}
    want = plain_manifest([(d["lang"], d["doc_id"], leaf[d["doc_id"]]) for d in docs], 2)
    want = {x[1]: x for x in want}
    got = queries.op13_merkle_manifest(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        key, _, subroot, root, steps = want[leaf[r["doc_id"]]]
        steps = eval(steps)
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf[r["doc_id"]], subroot, root)
        assert r["proof_sha256"] == sha(*[a + b for a, b in steps])
        d = next(d for d in docs if d["doc_id"] == r["doc_id"])
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        node = sha(*[field(v) for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"] + touched, d["text"])])
        for before, after in steps:
            node = sha(before, node, after)
        assert r["folded_root"] == node and r["verified"] == (node == root) and r["verified"] != touched


def test_manifest_of_odd_rows(spark, odd, odd_rows, empty):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    def leaves(rows):  # noqa: E306
        return rows.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), merkle.leaf_hash(*fields).alias("leaf"), F.lit(1).alias("row"))

    got = merkle.manifest(leaves(odd), levels=1).withColumn("folded", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
    assert len(got) == len(odd_rows) and len({r["root"] for r in got}) == 1 and all(r["folded"] == r["root"] for r in got)
    plain = plain_manifest([(r[2], r[0], sha(*[field(v) for v in (r[0], r[3], r[2], r[4], r[1])])) for r in odd_rows], 2)
    assert sorted(x[1:4] for x in plain) == sorted((r["leaf"], r["subroot"], r["root"]) for r in got)
    assert merkle.manifest(leaves(empty)).count() == 0


MARKS = ["[INST] ", " [/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "[ROLE dXNlcg==]", "[INST]", "[/INST]"]


def plain_escape(text):
    out, i = "", 0
    inner = ["INST]", "/INST]", "ROLE ", "/ROLE]", "s>", "/s>", "<SYS>>", "</SYS>>"]
    while i < len(text):
        out += text[i]
        if text[i] in "<[":
            j = i + 1
            while j < len(text) and text[j] == "\\":
                j += 1
            if any(text.startswith(x, j) for x in inner):
                out += "\\"
        i += 1
    return out


def fuzzed(rng):
    parts = [*MARKS, "\\", "<\\s>", "[\\\\/INST]", "<\\", "<", "[", "SYS>>", " ", "\n", "é", "😀", "word", "", "<\\<SYS>>", "$1", "ROLE"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def test_formatting_comes_back(spark):
    """Texts made of marks, parts of marks and backslashes; any role; what is put out, and the spans, by a plain renderer."""
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", "User", "rôle]", "x" * 100]
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(roles), fuzzed(rng)))
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role, text))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    frame = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string")
    chats = chat.formatted(frame).cache()
    out = {r["conv_id"]: r for r in chats.collect()}
    assert {r["rounds"] for r in out.values()} == {1, 2}
    for r in chat.read_back(chats).collect():
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(text for role, text in turns if role == "assistant")
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in out[r["conv_id"]]["loss"]]
        assert spans == [plain_escape(text) for role, text in turns if role == "assistant"]
        for mark in MARKS[:-2]:
            assert not any(mark in plain_escape(text) for _, text in turns)
    plain = [r for r in out.values() if not any(plain_escape(t) != t for _, t in want[r["conv_id"]])]
    assert plain and all(r["rounds"] == 1 for r in plain)


def test_formatting_odd_rows(spark, empty):
    rows = [(1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (None, 2, "user", "b"), (None, 1, "user", "a"), (2, 1, "assistant", "long " * 100_000 + "</s>" * 50)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("found", F.lit(2))
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(frame)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("", ""), ("assistant", ""), ("assistant", "")]
    assert [t["text"] for t in back[None]["turns"]] == ["a", "b"] and back[2]["loss_text"] == rows[-1][3]
    none = empty.selectExpr("doc_id as conv_id", "n_chars as turn", "source as role", "text")
    assert chat.formatted(none).count() == 0
    broken = spark.createDataFrame([(1, "[INST] a</s>", None)], f"conv_id long, formatted string, loss {chat.SPANS}")
    with pytest.raises(Exception, match="does not follow the grammar"):
        chat.read_back(broken).collect()


def test_chat_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op11_chat_format(spark, SF).collect()
    assert {r["conv_id"] for r in got} == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
    for r in got:
        turns = [(role, text or "") for c, _, role, text in sorted(rows, key=lambda x: x[:2]) if c == r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), sha(loss))
        assert r["turns_sha256"] == sha(*[f"{a}\n{b}\n" for a, b in turns])
        assert r["formatted_chars"] >= sum(len(t) for _, t in turns)
