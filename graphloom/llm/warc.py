"""WARC archives: writing request, response or revisit and metadata records, streaming them back, and assembling captures.

Archives are written by the text sink (gzip, with the record's closing CRLF CRLF as
line separator) and read line by line, so any store that Spark reaches serves and no
file is ever held in memory. Payloads may hold any bytes: a record's block is taken by
its Content-Length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, shared_dir, tidy

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 100
#: Groups of equal payloads up to which the tables of first captures (about 200 bytes a row) and of their records' ids are broadcast.
BROADCAST_GROUPS = 100_000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    """A record id made of its parts (those that are null leave their place empty)."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(name + ": "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)  # concat_ws leaves out headers that are null


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Three records for each row of pages (page_id, url, html): request, response or revisit, metadata.

    Of rows with equal payloads of MIN_REVISIT_BYTES or more the one with the smallest
    page_id (then url; a null page_id comes last) is a response, the others are revisits without payload; rows equal in all columns
    are alike, each a record of its own. A null html is an empty payload, a null url empty;
    white space in a url is percent-encoded.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload")).withColumn("serial", F.monotonically_increasing_id()).withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    place = F.struct(F.col("page_id").isNull().alias("unnumbered"), "page_id", "url", "serial")
    first = rows.filter(F.col("size") >= MIN_REVISIT_BYTES).select("digest", place.alias("place")).groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    shared_dir(pages.sparkSession)
    first = first.checkpoint()
    if first.count() <= BROADCAST_GROUPS:
        first = F.broadcast(first)
    rows = rows.join(first, "digest", "left")
    same = F.col("first").isNull() | (F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first.url") == F.col("url")))
    rows = rows.withColumn("revisit", ~same)
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"\s", "%20")
    ids = {k: _uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.col("serial"), F.lit(k)) for k in ("request", "response", "metadata")}
    refers = F.when(F.col("revisit"), _uuid(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.col("first.serial"), F.lit("response")))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    request = _record(F.lit("request"), [("WARC-Record-ID", ids["request"]), ("WARC-Concurrent-To", ids["response"]), *common, ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF * 2}")))
    response = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", ids["response"]),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
            ("WARC-Refers-To", refers),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload").cast("string"))),
    )
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", ids["metadata"]), ("WARC-Concurrent-To", ids["response"]), *common, ("Content-Type", F.lit("application/warc-fields"))], fields)
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write.text(path, compression="gzip", lineSep=CRLF * 2)


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """name: value lines; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        s = line.decode("utf-8", "replace")
        if s[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {s.strip()}")
        elif ":" in s:
            name, _, value = s.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse_records(lines: Iterator[bytes], payload: bool) -> Iterator[tuple]:
    """Records of an archive's CRLF-separated lines; what stands between records is skipped."""
    for line in lines:
        if not line.startswith(b"WARC/"):
            continue
        head = []
        for part in lines:
            if not part:
                break
            head.append(part)
        headers = dict(reversed(_fields(head)))  # of a repeated header the first counts
        try:
            left = int(headers.get("content-length", "0"))
        except ValueError:
            left = 0
        block = []
        while left > 0:
            part = next(lines, None)
            if part is None:
                break
            block.append(part)
            if len(part) >= left:
                left = 0
            else:
                left -= len(part) + 2
                if not left:
                    block.append(b"")
        kind, body = headers.get("warc-type", "").lower(), b"\r\n".join(block)
        size = digest = None
        fields: list[tuple[str, str]] = []
        content: bytes | None = None
        if kind in ("response", "revisit", "request"):
            top, _, content = body.partition(b"\r\n\r\n")
            fields = _fields(top.split(b"\r\n")[1:])
        elif headers.get("content-type", "") == "application/warc-fields":
            fields = _fields(body.split(b"\r\n"))
        else:
            content = body
        if kind == "revisit":
            length = dict(fields).get("content-length", "")
            size = int(length) if length.isdigit() else None
            digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
        elif content is not None:
            size, digest = len(content), hashlib.sha256(content).hexdigest()
        yield (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), list(headers.items()), size, digest, content if payload else None, list(dict(fields).items()))


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of gzip archives below path; payload_bytes and payload_digest are those of the bytes read (of a revisit, those it states).

    Truncated records keep what there is; an empty archive has no rows. payload: False leaves the bytes out.
    Archives must be gzip files, whole or one member a record, as Spark then gives each to one task in order.
    """
    lines = spark.read.text(path, lineSep=CRLF).select(F.col("value").cast("binary").alias("value"))
    schema = RECORD
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = [x.strip().split()[0] for x in RECORD.replace("map<string,string>", "map").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (line.as_py() for batch in batches for line in batch.column(0))
        rows: list[tuple] = []
        held = 0
        for record in parse_records(stream, payload):
            rows.append(record)
            held += 1000 + len(record[9] or b"")
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return lines.mapInArrow(tidy(run), schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, response (a struct), requests, metadata (arrays, by record id).

    A response, revisit or resource is a capture; requests and metadata join the capture
    that their concurrent-to names. Records that name none, or one that is not there, make a
    capture without response. Repeated record ids of responses keep one (the greatest struct). A record with neither id
    is a capture of its own (capture_id null).
    """
    main = F.col("type").isin("response", "revisit", "resource")
    columns = [c for c in ("record_id", "type", "refers_to", "target_uri", "date", "headers", "payload_bytes", "payload_digest", "payload", "fields") if c in records.columns]
    plain = [F.map_entries(c).alias(c) if c in ("headers", "fields") else F.col(c) for c in columns]
    named = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    alone = F.when(named.isNull(), F.monotonically_increasing_id())  # parts records without id
    rows = records.select(named.alias("capture_id"), alone.alias("alone"), F.col("type"), F.struct(*plain).alias("record"))
    grouped = rows.groupBy("capture_id", "alone").agg(
        F.max(F.when(main, F.col("record"))).alias("response"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", F.col("record")))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", F.col("record")))).alias("metadata"),
    )
    return grouped.drop("alone")


def page_digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures.

    refers_to is the page_id of the capture whose response a revisit's WARC-Refers-To names; null if there is none.
    """
    work = Workspace(captures.sparkSession, "warc-pages")
    fields = F.map_from_entries(F.get("metadata", F.lit(0))["fields"])
    pages = work.write(
        captures.select(
            F.nullif(fields["pageid"], F.lit("")).cast("long").alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            "capture_id",
            F.col("response.refers_to").alias("named"),
        ),
        "pages",
    )
    named = pages.filter("record_type = 'revisit' and named is not null").select("named").distinct()
    # written, so that the join below can be split where a third of all pages name one response
    targets = work.write(pages.select(F.col("capture_id").alias("named"), F.col("page_id").alias("refers_to")).join(named, "named", "left_semi"), "targets")
    if targets.count() <= BROADCAST_GROUPS:
        targets = F.broadcast(targets)
    return pages.join(targets, "named", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))
