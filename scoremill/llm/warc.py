"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

A response becomes a conversion record with the text of its payload and a metadata record with the response's HTTP
status and headers, its digests, and the identifier and digest of the conversion. Both name the response in
WARC-Refers-To and keep its target and date. Identifiers follow from the content, so a job that runs again makes the
same records. Everything is one pass over the rows; only character references are resolved in Python.
"""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.llm.arrays import small_batches
from scoremill.llm.words import text_of

VERSION = "WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
CRLF = "\r\n"
HTML = r"(?i)^\s*(text/html|application/xhtml\+xml)"
PLAIN = r"(?i)^\s*text/plain"
# Elements without text for a reader, and comments; an element that is never closed runs to the end. A name ends at white
# space, a slash or >, so <svg-icon> is none of them, and <svg/> has no content.
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<svg(?:\s[^>]*)?/>"
    r"|<(script|style|noscript|template|svg)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)"
)
BLOCKS = (
    "address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|"
    "header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
BREAKING = rf"(?i)</?(?:{BLOCKS})\b[^>]*>"
TAG = r"<[A-Za-z/!?][^>]*>"


def digest(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in base 32, as WARC headers carry it."""
    def coded(h: Column) -> Column:
        quarters = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
        # base 32 there counts 0-9 and then letters, here letters and then 2-7
        digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        return F.concat(F.lit("sha1:"), F.translate(F.upper(F.concat(*quarters)), digits, letters))

    return F.transform(F.array(F.sha1(text)), coded)[0]  # the text is hashed once


def identifier(*parts: Column) -> Column:
    """Record identifier that follows from the parts."""
    key = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    uuid = F.regexp_replace(key, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5")
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages (page_id, url, html).

    page_id, record_id, target_uri, date, http_headers, payload, payload_digest, block_digest. A null url is the empty
    one, null html an empty payload. Rows that repeat everything give the same identifier.
    """
    body = text_of("html")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF),
    )
    base = pages.select(
        "page_id", text_of("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), body.alias("payload")
    )
    whole = F.concat("http_headers", F.lit(CRLF), "payload")
    dug = base.withColumns({"payload_digest": digest(F.col("payload")), "block_digest": digest(whole)})
    record = identifier(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.col("block_digest"))
    return dug.withColumn("record_id", record)


def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def plain_text(payload: Column, content_type: Column) -> Column:
    """Text of an HTML or plain payload, null for other types.

    Of HTML, hidden elements and comments go, tags of blocks break lines, other tags go (a tag ends at the first
    ``>``), character references are resolved, blanks are single, and lines are trimmed and not empty.
    """
    shown = F.regexp_replace(payload, HIDDEN, "")
    bare = F.regexp_replace(F.regexp_replace(shown, BREAKING, "\n"), TAG, "")
    resolved = F.arrow_udf(_unescape, "string")(bare)
    lines = F.regexp_replace(F.regexp_replace(resolved, r"[ \t\x0B\f\r ]+", " "), r" ?\n[ \n]*", "\n")
    trimmed = F.trim(lines, F.lit(" \n"))
    return F.when(content_type.rlike(HTML), trimmed).when(content_type.rlike(PLAIN), payload)


def derive(records: DataFrame, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Metadata and conversion records of responses (the columns of ``responses``), with the columns in ``carry``.

    warc_type, record_id, refers_to, target_uri, date, content_type, source_digest, block_digest, content_length, block.
    A payload that is neither HTML nor plain text has no conversion, which its metadata says. A response without
    HTTP headers counts as HTML. Null columns are empty, repeated rows give repeated records, an empty table none;
    further columns are ignored.
    """
    small_batches(records)
    headers = F.filter(F.split(F.coalesce("http_headers", F.lit("")), r"\r?\n"), lambda h: h != "")
    status = F.get("headers", F.lit(0))
    named = F.filter("headers", lambda h, i: i > 0)
    kind = F.get(F.filter("named", lambda h: F.lower(h).startswith("content-type:")), F.lit(0))
    known = (
        records.select(
            *carry,
            "record_id",
            F.coalesce("target_uri", F.lit("")).alias("target_uri"),
            F.coalesce("date", F.lit("")).alias("date"),
            F.coalesce("payload", F.lit("")).alias("payload"),
            F.coalesce("payload_digest", F.lit("")).alias("payload_digest"),
            F.coalesce("block_digest", F.lit("")).alias("source_block_digest"),
            headers.alias("headers"),
        )
        .withColumns({"status": F.coalesce(status, F.lit("")), "named": named})
        .withColumn("kind", F.coalesce(F.substring_index(kind, ":", -1), F.lit("text/html")))
    )
    text = known.withColumn("text", plain_text(F.col("payload"), F.col("kind"))).drop("payload")
    dug = text.withColumn("text_digest", digest(F.col("text")))
    conversion_id = F.when(
        F.col("text").isNotNull(), identifier(F.lit("conversion"), F.col("record_id"), F.col("text_digest"))
    )
    dug = dug.withColumn("conversion_id", conversion_id)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    fields = F.concat(
        line("source-record-id", F.coalesce("record_id", F.lit(""))),
        line("source-payload-digest", F.col("payload_digest")),
        line("source-block-digest", F.col("source_block_digest")),
        line("source-http-status", F.col("status")),
        F.array_join(F.transform("named", lambda h: line("source-http-header", h)), ""),
        line("conversion-record-id", F.coalesce("conversion_id", F.lit("none"))),
        line("conversion-block-digest", F.coalesce("text_digest", F.lit("none"))),
    )

    def record(warc_type: str, record_id: Column, content_type: str, block: Column, block_digest: Column) -> Column:
        return F.struct(
            F.lit(warc_type).alias("warc_type"),
            record_id.alias("record_id"),
            F.lit(content_type).alias("content_type"),
            block_digest.alias("block_digest"),
            F.octet_length(block).cast("bigint").alias("content_length"),
            block.alias("block"),
        )

    both = F.array(
        record("metadata", F.col("metadata_id"), "application/warc-fields", F.col("fields"), F.col("fields_digest")),
        record("conversion", F.col("conversion_id"), "text/plain; charset=utf-8", F.col("text"), F.col("text_digest")),
    )
    linked = dug.withColumn("fields", fields).withColumn("fields_digest", digest(F.col("fields")))
    linked = linked.withColumn(
        "metadata_id", identifier(F.lit("metadata"), F.col("record_id"), F.col("fields_digest"))
    ).withColumn("r", F.explode(both))
    return linked.where("r.record_id IS NOT NULL").select(
        *carry,
        "r.warc_type",
        "r.record_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "r.content_type",
        F.col("payload_digest").alias("source_digest"),
        "r.block_digest",
        "r.content_length",
        "r.block",
    )


def serialised(records: DataFrame) -> Column:
    """A derived record as it stands in a file, without the last line end."""
    rows = [
        ("WARC-Type", "warc_type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
        ("Content-Length", "content_length"),
    ]
    value = lambda c: records[c].cast("string")
    # a header without a value is left out
    lines = [F.when(value(c) != "", F.concat(F.lit(f"{n}: "), value(c), F.lit(CRLF))) for n, c in rows]
    return F.concat(F.lit(VERSION + CRLF), F.concat_ws("", *lines), F.lit(CRLF), records["block"], F.lit(CRLF))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derived records as WARC files, one per partition, into a new folder."""
    lines = records.select(serialised(records).alias("value"))
    lines.write.option("lineSep", CRLF).option("compression", compression).text(path)
