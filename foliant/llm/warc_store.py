"""Content-addressed WARC archive.

An archive is a folder of three tables. `index` names the response of each distinct payload by its
SHA-256 digest; `payloads` has the bytes of each digest once; `headers` has the exact header block of
each record. A record is its header block, its payload (none for a revisit) and two line ends, put
together again by a join on the digest, which is verified against the bytes as they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch

#: Fixed values of the format: the version line, line end, and RFC 4648's alphabet in order of value.
VERSION, LINE_END = "WARC/1.1", "\r\n"
ENDS = (LINE_END * 2).encode()
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column, digits: int = 40) -> Column:
    """RFC 4648 base32 of a hex digest of a multiple of five bytes: five hex digits make four."""
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, i + 1, 5), 16, 32)), 4, "0") for i in range(0, digits, 5)]
    return F.translate(F.concat(*parts), "0123456789abcdefghijklmnopqrstuv", BASE32)


def _with_digests(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    return pages.select(
        F.col(id_col).alias("record_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
    ).withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def _header(date: str) -> Column:
    """The header block, with the blank line that ends it."""
    uri = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    one_line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    revisit = F.col("refers_to").isNotNull()
    return F.encode(
        F.concat_ws(
            LINE_END,
            F.lit(VERSION),
            F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), uri(F.col("record_id"))),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Target-URI: "), one_line),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("refers_to")))),
            F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
            F.lit("Content-Type: text/html"),
            F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
            F.lit(LINE_END),
        ),
        "UTF-8",
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per row of `pages` to the folder `path`, which must not exist.

    A null body is the empty payload and a null url an empty one. Of the rows with one payload of at
    least `min_revisit_bytes` bytes those with the smallest id are responses, the others revisit it;
    rows with a null id are responses. Rows that repeat an id are a record each. Rows that share a
    payload are told apart before any payload moves: the index holds digests and ids alone and is
    pre-aggregated, so a payload that a third of the rows have costs a few bytes a row.
    """
    spark = pages.sparkSession
    rows = _with_digests(pages, id_col, url_col, body_col)
    scratch = Scratch(spark, "warc")
    told = scratch.write(rows.drop("payload"), "digests")  # what follows hashes no payload again but to write it
    eligible = (F.col("payload_bytes") >= min_revisit_bytes) & F.col("record_id").isNotNull()
    told.where(eligible).groupBy("sha256").agg(F.min("record_id").alias("response_id")).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    other = eligible & (F.col("record_id") != F.col("response_id"))
    typed = told.join(index, "sha256", "left").withColumn("refers_to", F.when(other, F.col("response_id")))
    typed.select("record_id", "sha256", _header(date).alias("header")).write.parquet(f"{path}/headers")
    # The bytes of a digest come from its response, else (null ids, small payloads) from any row that has it.
    # Rows that repeat a response meet in the partition of their id, so the bytes move once.
    named = rows.select("record_id", "sha256", "payload").join(
        index.select(F.col("response_id").alias("record_id"), F.col("sha256").alias("of")), "record_id"
    )
    payloads = named.where("sha256 = of").groupBy("record_id", "sha256").agg(F.any_value("payload").alias("payload")).select("sha256", "payload")
    if told.where(~F.coalesce(eligible, F.lit(False))).limit(1).count():
        rest = rows.where(~F.coalesce(eligible, F.lit(False))).select("sha256", "payload")
        rest = rest.join(index, "sha256", "left_anti").groupBy("sha256").agg(F.any_value("payload").alias("payload"))
        payloads = payloads.unionByName(rest)
    payloads.write.parquet(f"{path}/payloads")
    scratch.drop(told)


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record: record_id, record_type, refers_to, header, payload, record, sha256,
    payload_bytes, payload_digest, record_bytes.

    Type and both ids, of type `id_type`, are read from the header block; "none" is a null id. `payload` is
    the full one, for a revisit that of the response; `record` has the exact bytes of the record as written.
    Whatever is asked of a payload comes from bytes that were held against their digest; one whose bytes
    don't have its digest, and one that is missing, raises an error. Lengths and digests are computed before
    the join, so a query that asks for neither payload nor record moves no payload.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    spoilt = F.raise_error(F.concat(F.lit("payload does not have its digest "), F.col("sha256"))).cast("binary")
    stored = stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(spoilt))
    stored = stored.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_of_hex(F.sha1("payload"))})
    missing = F.raise_error(F.concat(F.lit("no payload of digest "), F.col("sha256")))
    found = {c: F.coalesce(c, missing.cast(kind)) for c, kind in (("payload", "binary"), ("payload_bytes", "long"), ("payload_digest", "string"))}
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    uri = lambda name: F.nullif(F.regexp_extract(field(name), "^<urn:record:(.*)>$", 1), F.lit("none"))
    refers_to = uri("WARC-Refers-To")
    heads = spark.read.parquet(f"{path}/headers").select(
        uri("WARC-Record-ID").cast(id_type).alias("record_id"), field("WARC-Type").alias("record_type"),
        F.when(refers_to != "", refers_to).cast(id_type).alias("refers_to"), "header", "sha256",
    )
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    size = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    return (
        heads.join(stored, "sha256", "left")
        .withColumns(found)
        .withColumns(
            {
                "record": F.concat("header", body, F.lit(ENDS)),
                "record_bytes": F.octet_length("header") + size + len(ENDS),
            }
        )
        .select("record_id", "record_type", "refers_to", "header", "payload", "record", "sha256", "payload_bytes", "payload_digest", "record_bytes")
    )
