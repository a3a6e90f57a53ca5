"""Language filters, quality classifier and token counts."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodespark.llm import language_id, quality, token_counts
from lodespark.llm.common import held_out, learnable, pieces, table
from tests.llm.conftest import SF, prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_grams(text):
    """Windows of three and four characters whose inner ones are letters, letters and blanks only."""
    chars = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    out = []
    for n in (3, 4):
        for i in range(len(chars) - n + 1):
            if all(c != " " for c in chars[i + 1 : i + n - 1]):
                out.append("".join(chars[i : i + n]))
    return out


def test_popcounts_match_plain_sets():
    masks = np.zeros((1, language_id.SLOTS), dtype=np.uint8)
    known = ["the cat", "der hund"]
    for lang, text in enumerate(known):
        for where in language_id.slots(language_id.ngrams([text])[0]):
            masks[0, where] |= np.uint8(1 << lang)
    model = language_id.LanguageFilter(["de", "en"], masks, np.zeros(2), 0)
    texts = ["The cat, the dog", "", "hund!", "42"]
    n, hits, _ = language_id.popcounts(model, texts)
    for k, text in enumerate(texts):
        grams = plain_grams(text)
        assert n[k] == len(grams)
        for lang, source in enumerate(known):
            assert hits[k, lang] == sum(g in set(plain_grams(source)) for g in grams)


def test_false_positives_are_taken_off():
    model = language_id.LanguageFilter(
        ["a", "b"], np.full((1, language_id.SLOTS), 0b11, np.uint8), np.array([0.5, 0.9]), 0
    )
    langs, score, _ = language_id.decide(model, ["some text here"])
    assert langs == ["a"] and score[0] == 1
    model.masks[:] = 0
    assert language_id.decide(model, ["some text here", "1", ""])[0] == ["a", "und", "und"]


def test_more_than_eight_languages():
    masks = np.zeros((2, language_id.SLOTS), dtype=np.uint8)
    for where in language_id.slots(language_id.ngrams(["zebra"])[0]):
        masks[1, where] |= np.uint8(2)
    model = language_id.LanguageFilter([f"l{i}" for i in range(10)], masks, np.zeros(10), 0)
    assert language_id.decide(model, ["zebra"])[0] == ["l9"]


def test_long_texts_are_cut_without_loss():
    text = prose(1, 2000)
    assert "".join(pieces(text, 100)) == text and max(map(len, pieces(text, 100))) <= 100
    assert list(pieces("x" * 250, 100)) == ["x" * 100, "x" * 100, "x" * 50]
    whole = sorted(language_id.ngrams([text])[0].tolist())
    assert sorted(h for p in pieces(text, 100) for h in language_id.ngrams([p])[0].tolist()) == whole
    assert quality._document_features(text)[0].size


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs, language_id.learn(docs, learnable(F.col("doc_id"))))
    wrong = got.join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id")))
    assert wrong.filter("lang_pred <> lang").count() <= 0.02 * wrong.count()
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_odd_rows(spark, odd, odd_rows, empty):
    model = language_id.learn(odd, F.col("doc_id") >= 0)
    assert model.langs == ["de", "en"]
    got = language_id.identify(odd, model).collect()
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (0, 1, 2, 4):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0
    assert by_id[3]["lang_pred"] in ("de", "en")
    none = language_id.learn(empty, F.lit(True))
    assert none.langs == [] and language_id.identify(empty, none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.keep_determined(odd, model, 0.0).columns == odd.columns


def test_quality_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.learn(docs, labels, learnable(F.col("doc_id")))
    rows = quality.score(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    again = quality.learn(docs.repartition(5), labels.repartition(3), learnable(F.col("doc_id")))
    assert np.array_equal(again.values, model.values) and again.bias == model.bias


def test_quality_score_is_the_softmax_of_the_mean():
    rng = np.random.default_rng(1)
    vectors, weights = rng.normal(size=(quality.BUCKETS, 4)), rng.normal(size=(2, 4))
    model = quality.QualityModel(vectors @ (weights[1] - weights[0]), 0.25)
    text = "Some words, and some more words"
    found = [b for bs, _ in quality.features([text]) for b in bs]
    logits = weights @ vectors[found].mean(axis=0) + np.array([0, 0.25])
    want = np.exp(logits[1]) / np.exp(logits).sum()
    assert abs(quality.scores(model, [text])[0] - want) < 1e-9


def test_repeated_words_share_a_pair_bucket():
    pairs = [set(quality.features([w])[1][0].tolist()) for w in ("und und und", "other other")]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 1


def test_quality_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame(
        [(6, 1, 0), (6, 0, 0), (8, 0, None), (11, None, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, text int"
    )
    model = quality.learn(odd, labels, F.lit(True))
    got = quality.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = quality.learn(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_token_counts_equal_the_tokenizer(spark, odd, odd_rows, empty):
    plain = Tokenizer.from_file(VOCABULARY)
    extra = ["a b ́c\x0bd\x1ce\x85f", "ΣΑΣ ΟΔΟΣ", "<|startoftext|>x<|ENDOFTEXT|>", "don't we'll 12345 £€ 日本語 🙂🙂", " " * 50]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    want = sorted(
        (str(r[0]), len((r[1] or "").encode()), len(plain.encode(r[1] or "", add_special_tokens=False).ids))
        for r in docs.collect()
    )
    got = sorted((str(r[0]), r[1], r[2]) for r in token_counts.token_counts(docs, VOCABULARY).collect())
    assert got == want
    assert token_counts.token_counts(empty, VOCABULARY).count() == 0


def test_token_counts_of_the_table(spark):
    plain = Tokenizer.from_file(VOCABULARY)
    docs = table(spark, SF, "documents")
    want = {r["doc_id"]: len(plain.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, VOCABULARY).collect()} == want


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "PART_BYTES", 64)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 50)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 20)
    data = (prose(4, 300) + " " + "y" * 500 + "\n" + prose(5, 30)).encode()
    assert b"".join(token_counts.parts(data)) == data
    with open(VOCABULARY, encoding="utf-8") as f:
        counter = token_counts.WordCounter(f.read())
    total = sum(n for b in token_counts._bundles([data]) for n in counter.counts([w for _, w in b]))
    assert total == len(Tokenizer.from_file(VOCABULARY).encode(data.decode(), add_special_tokens=False).ids)


def test_lettered_texts_stay_without_any_language(spark):
    schema = "doc_id long, text string, lang string"
    fold = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    for lang, ids in ((None, range(3)), ("", range(3)), ("en", fold)):
        rows = [(ids[0], "some clean words", lang), (ids[1], "12 34 ...", lang), (ids[2], None, lang)]
        docs = spark.createDataFrame(rows, schema)
        assert [r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()] == [ids[0]]
