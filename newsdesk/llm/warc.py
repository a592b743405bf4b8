"""Content-addressed web archive.

Every row becomes a WARC 1.1 record. Payload bytes are stored once by their SHA-256, whose uniqueness is verified by length and SHA-1;
the exact record headers are stored separately, each with the digest of its payload. Joining the two tables on the digest gives back
every original record. So that no task gets all records of a common payload, a header also has a share: its payload's records are cut into
shares of about ``SHARE``, and reading joins on digest and share.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is the response; the others revisit it.

Defined results: null html is an empty payload; rows that repeat the largest id are all responses; a null id is never the response
of others unless all ids of its group are null, and then all are responses; a null url has no target line; line ends in a url are
percent-encoded; a very long payload is one value of its row and digested whole; an empty table gives empty tables; extra columns don't
matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, stored

MIN_REVISIT = 1000
#: Records of one payload that are read together, about.
SHARE = 1000
DATE = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """headers: page_id, sha256, share, header (exact text of the record's header). payloads: sha256, shares, payload, one row a digest."""

    headers: DataFrame
    payloads: DataFrame


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:newsdesk:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, date: str = DATE) -> Archive:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    index = stored(rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "records")
    groups = index.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.min("sha1").alias("least"), F.max("sha1").alias("most"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.count("*").alias("records"))
    same = (F.col("least") == F.col("most")) & (F.col("shortest") == F.col("longest"))
    owner = F.when(same, F.col("owner")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("sha256"))))
    groups = stored(groups.select("sha256", owner.alias("owner"), "records", F.ceil(F.col("records") / SHARE).cast("int").alias("shares")), "digests")
    revisit = (F.col("n") >= MIN_REVISIT) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("owner")))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    share = F.pmod(F.monotonically_increasing_id(), F.col("shares")).cast("int")
    headers = stored(join_hot(index, groups, "sha256", "records").select("page_id", "sha256", share.alias("share"), header.alias("header")), "headers")
    once = rows.select("sha256", "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    payloads = stored(once.join(groups.select("sha256", "shares"), "sha256").select("sha256", "shares", "payload"), "payloads")
    return Archive(headers, payloads)


def read(archive: Archive) -> DataFrame:
    """page_id, header, payload, payload_bytes, payload_digest, record_type, refers_to and record (WARC bytes as they stand in a file).

    Bytes and digests are computed anew from the stored payloads; a payload that no longer fits its digest, or a header that names
    another one, raises an error.
    """
    stored_once = archive.payloads.select(
        "sha256",
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        "payload",
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("long")).alias("payload_bytes"),
        F.sha1("payload").alias("sha1"),
    )
    line = lambda name: F.regexp_extract("header", f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    joined = archive.headers.join(stored_once, ["sha256", "share"])
    kind = line("WARC-Type")
    body = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    named = line("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))
    return joined.select(
        "page_id",
        "header",
        "payload",
        "payload_bytes",
        F.when(named, F.col("sha1")).otherwise(F.raise_error(F.lit("a header names another payload"))).alias("payload_digest"),
        kind.alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(header, '\\r\\nWARC-Refers-To: <urn:newsdesk:page:(-?[0-9]+)>', 1), '') AS bigint)").alias("refers_to"),
        F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )


ORACLE = rf"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, url, payload, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS owner FROM p),
r AS (SELECT *, n >= {MIN_REVISIT} AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner AS again FROM q),
h AS (
    SELECT *, 'WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || e || 'WARC-Record-ID: <urn:newsdesk:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || e || 'WARC-Date: {DATE}' || e
        || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || e, '') || 'WARC-Payload-Digest: sha1:' || sha1(payload) || e
        || CASE WHEN again THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || e || 'WARC-Refers-To: <urn:newsdesk:page:' || owner || '>' || e ELSE '' END
        || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || e || e AS header
    FROM r, (SELECT chr(13) || chr(10) AS e)
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to,
    sha256(encode(header) || CASE WHEN again THEN ''::BLOB ELSE payload END || encode(e || e)) AS record_sha256
FROM h
"""
