"""Operator 1: derivative builder for WARC responses.

Every response gives two linked records: ``metadata`` (source headers, digests, title, outgoing links) and
``conversion`` (the plain text of the page). Both carry the response's id in WARC-Refers-To, its target URI and date,
and the metadata names the conversion. All but the decoding of character references is column expressions; nothing is
gathered and no row is shuffled.
"""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CRLF = "\r\n"
#: Elements whose content is no text, and elements that end a line.
DROPPED = ("script", "style", "noscript", "template")
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
#: A character reference: decimal, hexadecimal or named (of those that HTML knows), closed by a semicolon.
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: (pattern, replacement), in order: comments, dropped elements, line-ending tags, other tags.
STEPS = (
    (r"(?s)<!--.*?-->", " "),
    *((rf"(?is)<{x}(?:[ \t\r\n\f/][^>]*)?>.*?</{x}[ \t\r\n\f]*>", " ") for x in DROPPED),
    (rf"(?i)</?(?:{BLOCKS})(?:[ \t\r\n\f/][^>]*)?>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
)
#: White space, after the references are decoded.
SPACES = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
TITLE = r"(?is)<title[^>]*>(.*?)</title"
#: The value of the link attribute of an anchor, with its quotes if it has any.
LINK = r"(?i)<a[ \t\r\n\f](?:[^>]*?[ \t\r\n\f])?href[ \t]*=[ \t]*(\"[^\"<>]*\"|'[^'<>]*'|[^ \t\r\n\f\"'<>]+)"
QUOTES = r"^[\"']|[\"']$"


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Text with its character references decoded once; a no-break space becomes a blank."""
    put = lambda m: html.unescape(m[0])
    return pd.Series([None if t is None else re.sub(REFERENCE, put, t).replace("\xa0", " ") if "&" in t or "\xa0" in t else t for t in text], dtype=object)


def plain_text(page: Column) -> Column:
    """Text of a page: no markup, scripts, styles or comments; one line for each block. Null and empty give ''."""
    text = F.coalesce(page, F.lit(""))
    for pattern, put in STEPS:
        text = F.regexp_replace(text, pattern, put)
    text = decoded(text)
    for pattern, put in SPACES:
        text = F.regexp_replace(text, pattern, put)
    return text


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def urn(*parts: Column | str) -> Column:
    """A record id that depends on nothing but its parts, so a task that runs again writes the same one."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def responses(pages: DataFrame, date: str, http: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8") -> DataFrame:
    """Response records of a table of pages (page_id, url, html); a null page_id, url or html counts as empty.

    A record's id follows from all three, so only rows that are equal in them share one: they are one capture, given twice.
    """
    url, page = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, digest(page)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"),
        F.lit(http).alias("http_headers"), page.alias("payload"), digest(page).alias("payload_digest"),
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Response records from whole WARC records in a column ``record``: header block, HTTP block, payload.

    Records of another type, and records without a header block, give no row.
    """
    parts = F.split("record", "\r\n\r\n", 3)
    head = F.get(parts, F.lit(0))
    field = lambda name: F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    payload = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    given = field("WARC-Payload-Digest")
    rows = lines.select(field("WARC-Type").alias("kind"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("http_headers"), payload.alias("payload"), F.when(given != "", given).otherwise(digest(payload)).alias("payload_digest"))
    return rows.where(F.lower("kind") == "response").drop("kind")


def derive(records: DataFrame) -> DataFrame:
    """Two rows a response: its metadata and its conversion, with headers, content, digests and the whole record.

    Columns of ``records``: record_id, target_uri, date, http_headers, payload, payload_digest; any others are kept, with
    an underscore before the name if a derived column has it.
    """
    text, title = plain_text(F.col("payload")), one_line(decoded(F.regexp_extract("payload", TITLE, 1)))
    conversion = urn(F.lit("conversion"), "record_id")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    found = F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(x, QUOTES, ""))
    links = F.filter(F.split(decoded(F.array_join(F.transform(found, lambda x: F.concat(x, F.lit("\n"))), "")), "\n"), lambda x: x != "")
    about = F.concat(
        line("source-record", F.col("record_id")), line("source-payload-digest", F.col("payload_digest")), line("derived-record", conversion),
        F.array_join(F.transform(F.split("http_headers", CRLF), lambda x: F.concat(F.lit("source-header: "), x, F.lit(CRLF))), ""),
        line("title", title), F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), urn(F.lit("metadata"), "record_id").alias("id"), F.lit("application/warc-fields").alias("content_type"), about.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), conversion.alias("id"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("content")),
    )
    given = ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")
    made = ("id", "refers_to", "source_digest", "warc_type", "content", "content_type", "content_length", "block_digest", "record")
    keep = [F.col(f"`{c}`").alias(f"_{c}" if c in made else c) for c in records.columns if c not in given]
    rows = records.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_digest"), F.inline(kinds))
    rows = rows.withColumnRenamed("id", "record_id").withColumn("content_length", F.octet_length("content").cast("long")).withColumn("block_digest", digest(F.col("content")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Source-Payload-Digest", F.col("source_digest")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.withColumn("record", F.concat(header, F.lit(CRLF), "content"))


def write_warc(derived: DataFrame, path: str) -> None:
    """Files of whole records, gzipped. The line separator of Spark's text writer is the end of a WARC record."""
    derived.select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Per derived record of a page: its links, digests, and the size and sha256 of the record as written."""
    rows = derive(responses(pages, date))
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_length", "source_digest", "block_digest", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


def oracle(date: str = "2024-01-01T00:00:00Z") -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, put in STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(put)}, 'g')"
    names = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    known = f"map([{', '.join(map(quote, names))}], [{', '.join(map(quote, names.values()))}])"
    name = f"regexp_extract('&' || x, {quote('^' + REFERENCE)}, 1)"
    code = f"CASE WHEN lower({name})[2] = 'x' THEN CAST('0x' || {name}[3:] AS INTEGER) ELSE CAST({name}[2:] AS INTEGER) END"
    char = f"CASE WHEN {name}[1] = '#' THEN chr({code}) ELSE coalesce(m[{name}], '&' || {name} || ';') END"
    piece = f"CASE WHEN i = 1 THEN x WHEN {name} = '' THEN '&' || x ELSE {char} || x[length({name}) + 2:] END"
    decode = lambda t: f"replace(array_to_string(list_transform(string_split({t}, '&'), lambda x, i: {piece}), ''), chr(160), ' ')"
    text = decode(text)
    for pattern, put in SPACES:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(put)}, 'g')"
    uuid = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
    ident = lambda kind, rest: uuid(f"md5('{kind}' || chr(31) || {rest})")
    nl = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
  {ident("response", "coalesce(CAST(page_id AS VARCHAR), '') || chr(31) || coalesce(url, '') || chr(31) || 'sha256:' || sha256(coalesce(html, ''))")} AS refers_to, {known} AS m FROM pages),
t AS (SELECT *, 'sha256:' || sha256(payload) AS source_digest, {ident("conversion", "refers_to")} AS conv_id, {text} AS body,
  trim(regexp_replace({decode(f"regexp_extract(payload, {quote(TITLE)}, 1)")}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS title,
  list_filter(string_split({decode(f"array_to_string(list_transform(regexp_extract_all(payload, {quote(LINK)}, 1), lambda x: regexp_replace(x, {quote(QUOTES)}, '', 'g') || chr(10)), '')")}, chr(10)), lambda x: x <> '') AS links FROM r),
k AS (SELECT page_id, target_uri, refers_to, source_digest, 'conversion' AS warc_type, conv_id AS record_id, 'text/plain; charset=utf-8' AS content_type, body AS content FROM t
 UNION ALL SELECT page_id, target_uri, refers_to, source_digest, 'metadata', {ident("metadata", "refers_to")}, 'application/warc-fields',
  'source-record: ' || refers_to || {nl} || 'source-payload-digest: ' || source_digest || {nl} || 'derived-record: ' || conv_id || {nl}
  || 'source-header: HTTP/1.1 200 OK' || {nl} || 'source-header: Content-Type: text/html; charset=utf-8' || {nl}
  || 'title: ' || title || {nl} || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {nl}), ''), '') FROM t),
d AS (SELECT *, CAST(strlen(content) AS BIGINT) AS content_length, 'sha256:' || sha256(content) AS block_digest FROM k),
w AS (SELECT *, 'WARC/1.1' || {nl} || 'WARC-Type: ' || warc_type || {nl} || 'WARC-Record-ID: ' || record_id || {nl} || 'WARC-Refers-To: ' || refers_to || {nl}
  || 'WARC-Target-URI: ' || target_uri || {nl} || 'WARC-Date: {date}' || {nl} || 'WARC-Source-Payload-Digest: ' || source_digest || {nl}
  || 'WARC-Block-Digest: ' || block_digest || {nl} || 'Content-Type: ' || content_type || {nl} || 'Content-Length: ' || content_length || {nl} || {nl} || content AS record FROM d)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_length, source_digest, block_digest,
  CAST(strlen(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256 FROM w"""
