"""Mix sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget.

Every source gets a share of all words by weight, at most ``cap`` times its own words; what a capped source leaves is
shared among the others by weight. A source's documents are put in the order of a hash of id and text. Whole epochs are
taken as often as they fit; of the next one the documents in front are taken until the budget is reached.

No task sees a whole source. Hash keys are spread evenly, so equal ranges of keys are equal buckets: prefix sums run
inside (source, bucket), and over the bucket totals of each source. Only ids, sources and sizes are shuffled. Rows that
agree in source, id and text are counted before, and their places follow from the count, however many they are.

Defined cases: a null text has size 0; a source without words has target 0; a null source is a source of its own, the
last one; null ids are equal ids; rows with equal ids and texts follow each other and are interchangeable, and
:func:`mixed_rows` takes them together; an empty table gives an empty table. Extra columns are ignored by :func:`mix` and kept by
:func:`mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodespark.llm.common import saved
from lodespark.session import bounded_broadcast

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows of a hash bucket over all sources; a source's prefix sums are taken inside one.
BUCKET_ROWS = 2_000
#: Equal rows that are written out together.
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    """Hash-random, and the same in every run and engine. The text is in it, as many rows may share an id or have none."""
    digest = F.md5(F.coalesce(text, F.lit("")))
    return F.substring(F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), digest)), 1, 16)


def source_key(source: Column) -> Column:
    """Never null, in the order of the sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("v"), source), F.lit("w"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source_key, size, key, n) of every different row, saved: what all passes but the last read."""
    rows = docs.select(
        "doc_id",
        source_key(F.col("source")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        mix_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    return saved(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "mix-keys")


def written_out(rows: DataFrame, largest: int) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``copy``; ``largest`` is the largest n."""
    if largest <= CHUNK:
        return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))))
    here = F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK)
    dealt = chunks.repartition("source_key", "key", "chunk")
    return dealt.withColumn(
        "copy", F.explode(F.transform(F.sequence(F.lit(0), here - 1), lambda i: F.col("chunk") * CHUNK + i))
    ).drop("chunk")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source_key, source_size, target, budget): one row per source.

    Sources fill up in the order of cap per weight. If the first k are full, the others get ``(all - their caps) /
    (all weights - their weights)`` per weight; the largest of these levels is the one that holds.
    """
    by_source = Window.orderBy("source_key")
    by_fill = Window.orderBy(F.col("full") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turns = F.array(*[F.lit(w) for w in weights])
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(by_fill), F.lit(0))).cast(
        "double"
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0))).cast("double")
    return (
        rows.groupBy("source_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn(
            "weight", F.element_at(turns, ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
        )
        .withColumn("full", F.col("source_size") * cap)
        .withColumn("level", level)
        .withColumn(
            "target",
            F.least(F.col("full").cast("double"), F.max("level").over(everything) * F.col("weight")),
        )
        .select("source_key", "source_size", "target", F.floor(F.col("target") + 0.5).alias("budget"))
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, source_key, key, size, source_size, target, epochs, rest, before, taken) of every row.

    ``before``: words of the source in front of the row; ``rest``: the budget beyond whole epochs; ``taken``: words
    the mix takes from the row. The row at the cut is taken in part, so each source's sum is its budget.
    """
    rows = keyed(docs)
    found = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
    buckets = max(1, -(-found["rows"] // bucket_rows))
    top = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(top * F.lit(buckets) / F.lit(float(1 << 32))).cast("long"))
    in_front = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("n")
    totals = (
        rows.groupBy("source_key", "bucket")
        .agg(F.sum(words).alias("bucket_size"))
        .withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(in_front), F.lit(0)))
        .drop("bucket_size")
        .join(targets(rows.withColumn("size", words), weights, cap), "source_key")
    )
    inside = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    left = F.least(F.col("size"), F.col("rest") - F.col("before"))
    placed = rows.withColumn("bucket_sum", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(
        totals, ["source_key", "bucket"]
    )
    return (
        written_out(placed, found["n"])
        .withColumn("before", F.col("bucket_before") + F.col("bucket_sum") + F.col("copy") * F.col("size"))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), left))
        .drop("bucket", "bucket_sum", "bucket_before", "budget", "n", "copy")
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as they are, repeated once per epoch that takes them.

    No document is cut here: the one at the cut is in if most of it lies before the cut. Per source only the last
    (key, id) that is in has to be known, so texts are neither shuffled nor joined to their words.
    """
    whole = mix(docs, weights, cap)
    inside = 2 * F.col("before") + F.col("size") < 2 * F.col("rest")
    cuts = whole.groupBy("source_key").agg(
        F.max("epochs").alias("__epochs"),
        F.max(F.when(inside, F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id")))).alias("__last"),
    )
    place = F.struct(
        mix_key(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id")
    )
    copies = F.col("__epochs") + F.coalesce((place <= F.col("__last")).cast("long"), F.lit(0))
    return (
        docs.withColumn("__source", source_key(F.col("source")))
        .join(bounded_broadcast(cuts.withColumnRenamed("source_key", "__source")), "__source")
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
