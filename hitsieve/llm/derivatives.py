"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hitsieve.llm.common import table

END = "\r\n"
_HIDES = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "template", "noscript")}
_TAG = re.compile(r"<(?:\s*+(?:/\s*+)?+(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|head|body|blockquote|pre)\b"
                  r"|[!/?a-zA-Z])[^>]*+>?", re.I)
_ZEROS, _HUGE = re.compile(r"(?<=&#)0{2,}"), re.compile(r"&#(?:[0-9]{8,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")
_SPACE = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")


def shown_parts(page: str) -> str:
    """A page without comments, scripts and the like; one that is not closed hides all that follows.

    The scan only goes forward: a closing mark is looked for from where its opening one ended, and the first that is
    missing ends the scan.
    """
    out, at = [], 0
    while found := _HIDES.search(page, at):
        out.append(page[at:found.start()])
        name = (found[1] or "").lower()
        if name:
            close = _ENDS[name].search(page, found.end())
            at = close.end() if close else len(page)
        else:
            close = page.find("-->", found.end())
            at = close + 3 if close >= 0 else len(page)
    return " ".join([*out, page[at:]])


def visible_text(page: str) -> str:
    """Text of a page: scripts, styles and comments go, block tags break lines, entities are decoded, blanks squeezed.

    Takes time in proportion to the page, closed or not. A numeric entity beyond all code points is a replacement sign.
    """
    body = _TAG.sub(lambda m: "\n" if m[1] and m[0].endswith(">") else "", shown_parts(page))
    body = html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("0", body)))
    return _LINES.sub("\n", _SPACE.sub(" ", body)).strip()


@F.arrow_udf(T.StringType())
def _visible(pages: pa.Array) -> pa.Array:
    return pa.array([visible_text(p.as_py() or "") for p in pages], pa.string())


def urn(*parts: Column) -> Column:
    """A record identifier that follows from its parts, so that a repeated run names its records alike."""
    h = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    a, b, c, d, e = (F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12)))
    # version 3 (a name's md5) and the variant bits of a UUID
    return F.concat(F.lit("<urn:uuid:"), a, F.lit("-"), b, F.lit("-3"), c, F.lit("-8"), d, F.lit("-"), e, F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, captured: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of fetched pages (page_id, url, html): identifier, headers, HTTP block."""
    body = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.octet_length(body).cast("string"), F.lit(END + END))
    key = [F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))]
    made = pages.select("page_id", F.lit("response").alias("warc_type"), urn(*key, F.md5(body.cast("binary"))).alias("record_id"),
                        F.col("url").alias("target_uri"), F.lit(captured).alias("warc_date"), F.concat(http, body).alias("block"))
    return made.withColumn("headers", F.create_map(
        F.lit("WARC-Block-Digest"), digest(F.col("block")), F.lit("WARC-Payload-Digest"), digest(payload(F.col("block")))))


def payload(block: Column) -> Column:
    """What follows the first empty line of an HTTP block; a block without one has no payload."""
    at = F.locate(END + END, block)
    return F.when(at > 0, F.substr(block, at + 4)).otherwise(F.lit(""))


def http_headers(block: Column) -> Column:
    """Names (lower case) and values of an HTTP head; of repeated names the last."""
    lines = F.slice(F.split(F.substring_index(block, END + END, 1), END), 2, 1 << 20)
    fields = F.filter(lines, lambda x: F.locate(":", x) > 1)
    return F.map_from_entries(F.array_compact(F.transform(F.array_distinct(F.transform(fields, _name)), lambda k: F.struct(
        k.alias("k"), F.element_at(F.filter(F.transform(fields, lambda x: F.struct(_name(x).alias("k"), F.trim(
            F.substr(x, F.locate(":", x) + 1)).alias("v"))), lambda x: x["k"] == k), -1)["v"].alias("v")))))


def _name(line: Column) -> Column:
    return F.lower(F.trim(F.substring_index(line, ":", 1)))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response of `records(record_id, target_uri, warc_date, warc_type, headers, block)`.

    The metadata record is a JSON object of the source's identifier, headers, digests, HTTP status and headers, title
    and links; the conversion record is the visible text of an HTML payload or a plain-text payload as it is, and is
    left out for other types. Both carry `refers_to`, the source's identifier, and name each other's identifier in
    `related_id`; identifiers follow from the source's identifier and the type. `source_block_digest` and
    `payload_digest` are those of the source's headers, or computed where a header is missing.

    Rows of other types give nothing. A null block counts as empty (no status, empty text of unknown type: metadata
    only); null identifiers, dates, addresses and headers stay null. Repeated rows give repeated records with equal
    identifiers. Extra columns pass through unless they bear the name of an output column.
    """
    made = ("warc_type", "record_id", "refers_to", "related_id", "target_uri", "warc_date", "content_type", "content_length", "block_digest",
            "source_block_digest", "payload_digest", "content")
    used = ("record_id", "target_uri", "warc_date", "warc_type", "headers", "block")
    extra = [c for c in records.columns if c not in made and c not in used]
    head = records.where(F.col("warc_type") == "response").withColumn("block", F.coalesce("block", F.lit("")))
    read = head.select(*extra, F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "headers", "block",
                       payload(F.col("block")).alias("_body"), http_headers(F.col("block")).alias("_http"))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(F.try_element_at("_http", F.lit("content-type")), F.lit("")), ";", 1)))
    known = lambda name, text: F.coalesce(F.try_element_at("headers", F.lit(name)), digest(F.col(text)))
    read = read.withColumns({"_kind": kind, "source_block_digest": known("WARC-Block-Digest", "block"), "payload_digest": known("WARC-Payload-Digest", "_body"),
                             "_meta": urn(F.lit("metadata"), F.coalesce("refers_to", F.lit(""))), "_text": urn(F.lit("conversion"), F.coalesce("refers_to", F.lit("")))})
    page = F.col("_kind").isin("text/html", "application/xhtml+xml")
    status = F.nullif(F.regexp_extract("block", r"^HTTP/\S+ (\d{3})", 1), F.lit("")).cast("int")
    links = F.when(page, F.regexp_extract_all("_body", F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    # the first title alone is looked at, so a page of unclosed titles is not searched again from each of them
    first = F.substr("_body", F.greatest(F.regexp_instr("_body", F.lit(r"(?i)<title\b")), F.lit(1)))
    title = F.when(page, F.nullif(F.trim(F.regexp_extract(first, r"(?is)\A<title[^>]*+>(.*?)</title", 1)), F.lit("")))
    described = F.to_json(F.struct(
        F.col("refers_to").alias("WARC-Refers-To"), F.col("target_uri").alias("WARC-Target-URI"), F.col("warc_date").alias("WARC-Date"),
        F.col("headers").alias("Source-Headers"), F.col("source_block_digest").alias("Source-Block-Digest"), F.col("payload_digest").alias("Source-Payload-Digest"),
        F.col("_text").alias("Conversion-Record"), status.alias("Status"), F.col("_http").alias("HTTP-Headers"), F.octet_length("_body").alias("Payload-Length"),
        title.alias("Title"), links.alias("Links")))
    same = [*extra, "refers_to", "target_uri", "warc_date", "source_block_digest", "payload_digest"]
    meta = read.select(*same, F.lit("metadata").alias("warc_type"), F.col("_meta").alias("record_id"), F.col("_text").alias("related_id"),
                       F.lit("application/json").alias("content_type"), described.alias("content"))
    text = read.where(page | (F.col("_kind") == "text/plain")).select(
        *same, F.lit("conversion").alias("warc_type"), F.col("_text").alias("record_id"), F.col("_meta").alias("related_id"),
        F.lit("text/plain").alias("content_type"), F.when(page, _visible("_body")).otherwise(F.col("_body")).alias("content"))
    both = meta.unionByName(text)
    return both.withColumns({"content_length": F.octet_length("content").cast("long"), "block_digest": digest(F.col("content"))}).select(*extra, *made)


def serialized(records: DataFrame) -> DataFrame:
    """One column `record`: the records in WARC format, without the two line ends that close each."""
    fields = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
              ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"),
              ("WARC-Source-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in fields]
    return records.select(F.concat_ws(END, F.lit("WARC/1.1"), *lines, F.lit(""), F.col("content")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the records as gzipped WARC files, one for each partition."""
    serialized(records).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
