"""Content-addressed web archive: payloads once, record headers apart.

A payload is stored once, under its SHA-256 digest and length, in a store of its own; the
exact WARC record header of every page is kept in another one. Records are reconstructed by
joining the two, after each payload has been digested again: a payload that no longer has
the digest that it is stored under, or a record without payload, fails the read.

Of records with equal payloads of at least ``least_bytes`` bytes, those with the smallest
page_id are responses and all others revisit them. Repeated rows of that page_id are
responses too. A null html is an empty payload, a null url an empty target. Records without
page_id cannot be referred to: they revisit the group's smallest page_id, and are responses
where no record of the group has one. Further columns are ignored; an empty table gives an
empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
PAGE = "urn:page:"
KEY = ["digest", "payload_bytes"]
HEADERS = "page_id long, digest string, payload_bytes long, header binary"
PAYLOADS = "digest string, payload_bytes long, payload binary"


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of a hex string whose bits are a multiple of 20."""
    groups = F.sequence(F.lit(0), (F.length(hexadecimal) / 5).cast("int") - 1)
    four = F.transform(
        groups,
        lambda i: F.lpad(F.conv(F.substring(hexadecimal, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"),
    )
    return F.translate(
        F.concat_ws("", four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``path``/headers and ``path``/payloads. Only one copy of a payload is stored."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("payload"),
    ).withColumns(
        {
            "digest": F.sha2("payload", 256),
            "sha1": base32(F.sha1("payload")),
            "payload_bytes": F.length("payload").cast("long"),
        }
    )
    # Digests only; what later steps read again is small and on the shared store.
    rows.select("page_id", "url", "digest", "sha1", "payload_bytes").write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    index.groupBy(KEY).agg(F.min("page_id").alias("first")).write.parquet(f"{path}/firsts")
    firsts = spark.read.parquet(f"{path}/firsts")

    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <{PAGE}"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "),
        F.regexp_replace("url", "[\\r\\n]", "%0A"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(
            revisit,
            F.concat(F.lit(f"{CRLF}WARC-Refers-To: <{PAGE}"), F.col("first").cast("string"), F.lit(">")),
        ).otherwise(""),
        F.lit(f"{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    index.join(firsts, KEY).select(
        "page_id", *KEY, F.encode(header, "UTF-8").alias("header")
    ).write.parquet(f"{path}/headers", compression="zstd")

    # One page of each payload brings it: the smallest page_id, or any of those without one.
    bearer = ["page_id", "digest", "payload_bytes"]
    wanted = firsts.select(F.col("first").alias("page_id"), *KEY)
    known = rows.select(*bearer, "payload").join(wanted.where("page_id IS NOT NULL"), bearer)
    nameless = rows.where("page_id IS NULL").select(*KEY, "payload")
    nameless = nameless.join(wanted.where("page_id IS NULL").select(*KEY), KEY)
    once = known.dropDuplicates(bearer).select(*KEY, "payload")
    once = once.unionByName(nameless.dropDuplicates(KEY).select(*KEY, "payload"))
    once.write.parquet(f"{path}/payloads", compression="zstd")


def _said(name: str) -> Column:
    """A header field; empty where the record has none."""
    return F.regexp_extract(F.decode("header", "UTF-8"), f"\r\n{name}: <?([^\r\n>]*)", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: ``page_id, record_type, url, refers_to, payload_bytes, payload_digest,
    header, payload``. Length and digest are those of the payload as read."""
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    found = stored.select(
        *KEY,
        "payload",
        F.length("payload").cast("long").alias("bytes_read"),
        base32(F.sha1("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("digest")).alias("verified"),
    )
    broken = F.raise_error(F.concat(F.lit("payload is lost or damaged: "), "digest"))
    whole = F.coalesce("verified", F.lit(False)) & (_said("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest"))
    refers = F.regexp_extract(_said("WARC-Refers-To"), f"{PAGE}(-?[0-9]+)", 1)
    return headers.join(found, KEY, "left").select(
        "page_id",
        F.when(whole, _said("WARC-Type")).otherwise(broken).alias("record_type"),
        _said("WARC-Target-URI").alias("url"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        F.col("bytes_read").alias("payload_bytes"),
        "payload_digest",
        "header",
        "payload",
    )
