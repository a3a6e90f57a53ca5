"""Content-addressed WARC archive: payload bytes once per strong digest, exact record heads beside them.

An archive is a folder with two tables. ``payloads`` holds (digest, payload), one row per different payload; the digest
is SHA-256, and a second independent hash and the length are checked to agree within it. ``heads`` holds one row per
record: its id, the digest of its payload and its head, the exact bytes from ``WARC/1.1`` to the HTTP head. A record
is read by joining its head to its payload. Of records with equal payloads the one with the largest id is written as
``response``, the others as ``revisit`` of it, without payload.

Defined cases: a null payload is an empty one; payloads under ``min_bytes`` are always responses; a row that repeats
the largest id and payload is a response too, and its bytes are still stored once; a null id is below all others; a
null address becomes ``urn:page:<id>``, line ends in an address are percent-encoded; an empty table makes an empty
archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Fixed value: the base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, null for null: each 5 hex digits of it are 4 letters."""

    def letters(group: Column) -> Column:
        value = F.conv(F.substring(F.sha1(data), group * 5 + F.lit(1), F.lit(5)), 16, 10).cast("int")
        return F.concat(
            *[
                F.substring(F.lit(BASE32), F.shiftright(value, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                for bits in (15, 10, 5, 0)
            ]
        )

    return F.when(data.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), ""))


def http_head(n_bytes: Column) -> Column:
    start = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])
    return F.concat(F.lit(start), n_bytes.cast("string"), F.lit(CRLF * 2))


def record_head(date: str) -> Column:
    """The head of a record: WARC fields, blank line, HTTP head."""
    revisit = F.col("record_type") == "revisit"
    http = http_head(F.col("n_bytes"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    address = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(address, F.concat(F.lit("urn:page:"), name))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF * 2), http)


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``pages`` into the archive at ``path``.

    Only digests, ids and addresses are joined; payloads are shuffled once, after copies within a task are merged.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    narrow = rows.select(
        "id",
        "url",
        "digest",
        F.octet_length("payload").cast("long").alias("n_bytes"),
        sha1_base32(F.col("payload")).alias("sha1"),
    )
    same = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("sha1") == F.max("sha1"))
    keepers = narrow.groupBy("digest").agg(
        F.when(same, F.max("id"))
        .otherwise(F.raise_error(F.lit("different payloads share a digest")).cast("long"))
        .alias("keeper")
    )
    first = (F.col("n_bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("keeper"))
    (
        narrow.join(keepers, "digest")
        .withColumn("record_type", F.when(first, F.lit("response")).otherwise(F.lit("revisit")))
        .select("id", "digest", record_head(date).alias("head"))
        .write.parquet(f"{path}/heads")
    )


def field(name: str) -> Column:
    """A field of a record's head; null if it has none."""
    value = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(id, head, record) of every record; ``record`` holds the exact bytes with payload and closing blank lines."""
    heads = spark.read.parquet(f"{path}/heads").withColumn("_type", field("WARC-Type"))
    stored = spark.read.parquet(f"{path}/payloads")
    end = F.lit((CRLF * 2).encode())
    # Revisits have no payload and take no part in the join.
    responses = heads.filter("_type = 'response'").join(stored, "digest", "left")
    whole = F.concat(F.encode("head", "UTF-8"), F.coalesce("payload", F.lit(b"")), end)
    bare = heads.filter("_type IS DISTINCT FROM 'response'")
    return responses.select("id", "head", whole.alias("record")).union(
        bare.select("id", "head", F.concat(F.encode("head", "UTF-8"), end).alias("record"))
    )


def record_facts(records: DataFrame) -> DataFrame:
    """(id, record_type, refers_to, payload_bytes, payload_digest) from the bytes of records.

    A response's payload is cut from its record by the head's length and hashed anew; a digest other than the
    record's own stops the job. A revisit has the facts of the response that it names.
    """
    number = r"<urn:page:(-?\d+)>"
    at = F.octet_length(F.encode("head", "UTF-8"))
    payload = F.expr("substring(record, _at + 1, octet_length(record) - _at - 4)")
    read = (
        records.withColumn("_at", at)
        .withColumn("record_type", field("WARC-Type"))
        .withColumn("refers_to", F.nullif(F.regexp_extract(field("WARC-Refers-To"), number, 1), F.lit("")).cast("long"))
        .withColumn("stated", F.regexp_extract(field("WARC-Payload-Digest"), "sha1:([A-Z2-7]+)", 1))
        .withColumn("payload", F.when(F.col("record_type") == "response", payload))
        .select(
            "id",
            "record_type",
            "refers_to",
            "stated",
            F.octet_length("payload").cast("long").alias("n"),
            sha1_base32(F.col("payload")).alias("found"),
        )
    )
    responses = read.filter((F.col("record_type") == "response") & F.col("id").isNotNull())
    named = responses.groupBy(F.col("id").alias("refers_to"), "stated").agg(F.first("n").alias("n_named"))
    sound = F.coalesce(F.col("found"), F.col("stated")) == F.col("stated")
    # Only records that name another one are joined.
    alone = read.filter("refers_to IS NULL").withColumn("n_named", F.lit(None).cast("long"))
    both = read.filter("refers_to IS NOT NULL").join(named, ["refers_to", "stated"], "left").select(*alone.columns)
    return both.union(alone).select(
        "id",
        "record_type",
        "refers_to",
        F.coalesce("n", "n_named").alias("payload_bytes"),
        F.when(sound, F.col("stated"))
        .otherwise(F.raise_error(F.lit("a record's payload does not match its digest")).cast("string"))
        .alias("payload_digest"),
    )
