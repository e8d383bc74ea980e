"""WARC archives: one request, response (or revisit) and metadata record per page, written and read
back as Spark text, and assembled into captures through WARC-Concurrent-To.

Files. Spark's text writer with gzip puts the records of a partition into one file, so any store
and Spark's commit protocol serve; gzip keeps a file in one task when it is read, line by line in
order, and no task holds more than a record. Payloads are UTF-8 here; the reader takes any bytes.

Revisits. Of records with equal payloads of at least ``least`` bytes, the one with the smallest
page_id keeps the payload; the others are revisit records that name its page, its URL and the
digest. A smallest page_id that several rows share makes all those rows responses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, likely, scratch_path

VERSION = "WARC/1.1"
END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, headers: list, block):
    """A record as one string column, without the two line ends that close it. Null headers are
    left out."""
    named = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    head = F.concat_ws("\r\n", F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), *named, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END), block)


def records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(record) strings of all rows of ``pages`` (page_id, url, html), three to a row."""
    base = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html"))
    long = base.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = long.where("n > 1").select(F.col("digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    # pages without a copy stay where they are; a table of its own leaves the join free to split a payload of very many pages
    first = cut(first)
    marked = likely(base, "digest", first.select("d"), "some").withColumn("some", F.col("some") & (F.col("bytes") >= least))
    copies = marked.where("some").join(first, F.col("digest") == F.col("d"), "left")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in first.dtypes]
    joined = copies.union(marked.where("not some").select("*", *nothing)).drop("some")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    # ids are drawn once in a row and written with it: repeated rows stay separate captures
    ids = joined.select("*", revisit.alias("revisit"), *[F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias(x) for x in ("main_id", "request_id", "metadata_id")])
    # line ends cannot stand in a header or a request line
    safe = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    target, date = ("WARC-Target-URI", safe(F.col("url"))), ("WARC-Date", F.lit(_DATE))
    payload = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    reply = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [("WARC-Record-ID", F.col("main_id")), date, target, payload, reply], F.concat(http, "html"))
    back = [("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To-Target-URI", safe(F.col("first_url"))), ("WARC-Refers-To-Date", F.lit(_DATE))]
    revisited = _record("revisit", [("WARC-Record-ID", F.col("main_id")), date, target, payload, *back, reply], http)
    path = F.coalesce(safe(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1"), F.lit(END))
    concurrent = ("WARC-Concurrent-To", F.col("main_id"))
    request = _record("request", [("WARC-Record-ID", F.col("request_id")), date, target, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.when(F.col("revisit"), F.concat(F.lit("refers-to-page-id: "), F.col("first_id").cast("string"))), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")))
    about = _record("metadata", [("WARC-Record-ID", F.col("metadata_id")), date, target, concurrent, ("Content-Type", F.lit("application/warc-fields"))], F.concat(fields, F.lit("\r\n")))
    return ids.select(F.explode(F.array(request, F.when(F.col("revisit"), revisited).otherwise(response), about)).alias("record"))


def write(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write the pages as gzipped WARC files in the folder ``path``. An empty table leaves no record."""
    records(pages, least).write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(lines: Iterator[tuple[object, bytes]]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers and block of each record from (file, line without its line feed) in order. What a
    file holds after its last whole record is passed over."""
    file, state, head, block, want = None, "between", [], bytearray(), 0
    for name, line in lines:
        if name != file:
            file, state = name, "between"
        if state == "between":
            if line.startswith(b"WARC/"):
                state, head = "head", []
            continue
        if state == "head":
            line = line.rstrip(b"\r")
            if line:
                head.append(line)
                continue
            headers: dict[str, list[str]] = {}
            for h in head:
                key, _, value = h.decode("utf-8", "replace").partition(":")
                headers.setdefault(key.strip().lower(), []).append(value.strip())
            want, block, state = int((headers.get("content-length") or ["0"])[0]), bytearray(), "block"
            if not want:
                yield headers, b""
                state = "between"
            continue
        block += line
        block += b"\n"
        if len(block) >= want:
            yield headers, bytes(block[:want])
            state = "between"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the gzipped WARC files in ``path``: type, record_id, concurrent_to (array), uri,
    payload_digest (as the header has it), profile, payload_bytes and sha256 (of the payload that
    the block holds, after its HTTP header), http_length, fields (of application/warc-fields) and,
    unless ``payloads`` is false, payload."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    texts = ("type", "record_id", "concurrent_to", "uri", "payload_digest", "payload_bytes", "sha256", "http_length", "fields", "payload")
    types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())

    def run(batches):
        rows: list = []
        held = 0

        def batch():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(texts))

        def every():
            for b in batches:
                yield from zip(b.column("file").to_pylist(), b.column("line").to_pylist(), strict=True)

        for headers, block in _parse(every()):
            one = lambda k: (headers.get(k) or [None])[0]  # noqa: B023, E731
            kind, content = one("warc-type"), one("content-type") or ""
            payload, length, fields = block, None, None
            if content.startswith("application/http"):
                top, _, payload = block.partition(b"\r\n\r\n")
                for h in top.split(b"\r\n")[1:]:
                    k, _, v = h.partition(b":")
                    if k.strip().lower() == b"content-length" and v.strip().isdigit():
                        length = int(v)
            elif content.startswith("application/warc-fields"):
                fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if s]
            rows.append((kind, one("warc-record-id"), headers.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-payload-digest"), len(payload), hashlib.sha256(payload).hexdigest(), length, fields, payload if payloads else None))
            held += len(payload) + 500
            if held > 8 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    out = lines.mapInArrow(run, "type string, record_id string, concurrent_to array<string>, uri string, payload_digest string, payload_bytes long, sha256 string, http_length long, fields map<string,string>, payload binary")
    return out if payloads else out.drop("payload")


def assemble(made: DataFrame) -> DataFrame:
    """One nested row per capture: ``main`` (the response or revisit record), ``request`` and
    ``metadata`` (null if there is none; of several, the one with the smallest record id).

    A record belongs to a capture if it names the main record in WARC-Concurrent-To, is named by
    it, or does so through one other record of the transaction (metadata -> request -> response).
    Requests and metadata that belong to no main record are left out. ``made`` is read several
    times: pass a table or a checkpoint.
    """
    others = made.where("type in ('request', 'metadata')")
    main = made.where("type in ('response', 'revisit')")
    named = made.select("record_id", "type", F.explode("concurrent_to").alias("to"))
    pairs = named.select(F.col("record_id").alias("a"), F.col("to").alias("b")).where("a <> b")
    near = pairs.union(pairs.select("b", "a")).distinct()
    ids = main.select(F.col("record_id").alias("b"))
    direct = near.join(ids, "b", "left_semi").select("a", F.col("b").alias("main_id"))
    step = near.select(F.col("a").alias("c"), F.col("b").alias("a")).join(direct, "a").select(F.col("c").alias("a"), "main_id")
    beside = direct.union(step).where("a <> main_id").distinct()
    grouped = others.join(beside, others["record_id"] == beside["a"]).groupBy("main_id")
    columns = [F.struct(*[F.col(c) for c in others.columns])]
    parts = grouped.agg(*[F.min_by(columns[0], F.when(F.col("type") == k, F.col("record_id"))).alias(k) for k in ("request", "metadata")])
    whole = main.select("record_id", F.struct(*main.columns).alias("main"))
    return whole.join(parts, whole["record_id"] == parts["main_id"], "left").select("main", "request", "metadata")


def archive_round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to the shared folder, read the archives, assemble the
    captures and return per row: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, null urls and page_ids are left out of the headers (page_id
    stays null). A response's bytes and digest are those of the payload read back; a revisit's are
    those its headers state of the payload that it refers to. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least)
    captures = assemble(cut(read(spark, path, payloads=False)))
    revisit = F.col("main.type") == "revisit"
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.when(revisit, F.col("main.http_length")).otherwise(F.col("main.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("main.payload_digest", "^sha256:", "")).otherwise(F.col("main.sha256")).alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.when(revisit, F.col("metadata.fields")["refers-to-page-id"].cast("long")).alias("refers_to"),
    )
