import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size long, key string, path string, label int, fp long, _id long"
SF = "/root/testdata/sf0.001"


def prose(seed: int, words: int) -> str:
    """Invented words that do not repeat much."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973:x}er" for i in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, tiny and very long texts, ties and repeated rows."""
    long_text = prose(3, 40_000)
    texts = [
        None, "", " \n\t ", "é", "12 34 ...", "one two three", prose(1, 80), prose(1, 80), long_text, long_text + " more",
        "ONE Two\nthree four five", "x" * 5000, "<|endoftext|> it's " + prose(2, 30), "Released under the MIT License.",
    ]
    rows = []
    for i, text in enumerate(texts):
        lang = [None, "en", "de", ""][i % 4]
        source = [None, "a", "b", "", "c"][i % 5]
        rows.append((i, text, lang, source, None, 0.5, 1, 2, "k", "p", None, 3, 4))
    rows += [rows[6], rows[6], (None, "no id", "en", "a", 1, None, None, None, None, None, None, None, None)]
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
