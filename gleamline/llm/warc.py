"""WARC archives: writing pages with segmentation, and reassembling what was written.

A page becomes a ``response`` record, or a ``revisit`` of the response with the same payload that has the
largest page number.  Payloads are framed in chunked transfer coding; blocks longer than a segment
go on in ``continuation`` records.  Records are written by Spark's text writer, whose line separator is
the end of a WARC record, so files are written, compressed and committed as any table's.

Reading takes the files as they are.  Records are parsed by their lengths and decoded where they are
read; those in segments are read in a second pass over the files that hands on nothing else.  They are
grouped by the identifier of their origin, ordered by segment number and joined; the total length is
verified and the transfer coding decoded.  Only records in several segments are shuffled, and what meets
in one row is one record's block.

Equal payloads are told by SHA-1 and SHA-256.  They are counted by run first, so that a payload that a
third of all pages have spreads over the runs.

Defined cases: a null page is empty.  Payloads below ``least`` bytes are all responses.  Null page numbers
are smaller than any other and written as ``null``.  Pages of any length are written whole, in segments;
one page's payload meets in one row.  Of rows that repeat page number and payload one is
the response and the others revisit it.  An empty table gives no records; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleamline.llm.common import bounded, by_run, column, run_count, run_of, slices
from gleamline.session import staging_root

SEGMENT = 8 << 10
CHUNK = 8 << 10
#: Records in a file: with the segment's length a bound of what a reading task holds.
FILE_RECORDS = 256
END = "\r\n\r\n"
_VERSION = b"WARC/1.1\r\n"
_GZIP = b"\x1f\x8b"
#: What is read; records of other types describe the crawl, not pages, and are passed over.
PAGES = ("response", "revisit")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _pieces(data: bytes, size: int) -> list[bytes]:
    """``data`` in pieces of at most ``size`` bytes that end with whole UTF-8 characters."""
    out, at = [], 0
    while len(data) - at > size:
        to = at + size
        while to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return [*out, data[at:]]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    frames = [b"%x\r\n%b\r\n" % (len(p), p) for p in _pieces(payload, size) if p]
    return b"".join(frames) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk isn't as long as it says")
        at = end + 4 + n


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line breaks that end it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return _VERSION + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", "%20", value)


def page_records(
    page_id: str, url: str, payload: bytes, revisit_of: str | None, own: str, segment: int = SEGMENT
) -> list[bytes]:
    """A page's records: one, or one for each segment."""
    digest = base32_sha1(payload)
    shared = [
        ("WARC-Target-URI", _clean(url)), ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    head = [("WARC-Record-ID", f"<{own}>")]
    if revisit_of is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        more = [("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To", f"<{revisit_of}>")]
        return [record([*more, *head, *shared], block)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http + chunked(payload)
    parts = _pieces(block, segment)
    first = [("WARC-Type", "response"), *head, *shared]
    if len(parts) == 1:
        return [record(first, block)]
    out = [record([*first, ("WARC-Segment-Number", "1"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {n}')}>"),
            ("WARC-Target-URI", _clean(url)), ("WARC-Date", "2000-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", str(n)),
        ]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, part))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a file."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that should end at byte {at} doesn't")
        at += 4


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, runs: int | None = None) -> None:
    """Write an archive of ``pages`` (page_id, url, html) to the folder ``path``."""
    runs = runs or run_count(pages.sparkSession)
    html = F.coalesce(column("html").cast("string"), F.lit(""))
    rows = pages.select(
        column("page_id").alias("page_id"), F.coalesce(column("url").cast("string"), F.lit("")).alias("url"), html.alias("html"),
        run_of(column("page_id"), runs).alias("run"), F.unhex(F.sha2(html, 256)).alias("sha2"), F.unhex(F.sha1(html)).alias("sha1"),
    )
    key = ["sha2", "sha1"]
    best = by_run(rows.select("page_id", "run", *key), key, [F.max("page_id").alias("m")], [F.max("m").alias("best")])
    nth = F.row_number().over(Window.partitionBy("run", *key).orderBy(F.col("page_id").desc_nulls_last()))
    marked = rows.withColumn("nth", nth).join(best, ["run", *key])
    # The first of the rows that have the largest number is the response; rows of a run are told apart by nth.
    response = (F.col("nth") == 1) & F.col("page_id").eqNullSafe(F.col("best")) | (F.octet_length("html") < least)
    marked = marked.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page_id"), "url", "html", "nth",
        F.when(~response, F.coalesce(F.col("best").cast("string"), F.lit("null"))).alias("refers_to"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 2, 4 << 20):
            out = []
            for r in part.to_pylist():
                payload = r["html"].encode()
                digest = base32_sha1(payload)
                own = f"urn:x-page:{r['page_id']}:{digest}:{r['nth'] - 1}"
                to = r["refers_to"] and f"urn:x-page:{r['refers_to']}:{digest}:0"
                out += page_records(r["page_id"], r["url"], payload, to, own, segment)
            for b in slices([pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], names=["value"])]):
                yield b

    records = marked.mapInArrow(run, "value string")
    files = records.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS)
    files.option("compression", "gzip").text(path)


def _payload(record_id: str, record_type: str, digest: str | None, total: int | None, block: bytes) -> tuple:
    """(length, payload) of a whole record, verified; a revisit has the length its head tells and no payload."""
    if total is not None and total != len(block):
        raise ValueError(f"{record_id}: segments have {len(block)} bytes instead of {total}")
    http = block.startswith(b"HTTP/")
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    lines = (line.partition(b":") for line in head.lower().split(b"\r\n")[1:])
    fields = {name.strip(): value.strip() for name, _, value in lines}
    if record_type == "revisit":
        length = fields.get(b"content-length")
        return length and int(length), None
    if fields.get(b"transfer-encoding") == b"chunked":
        body = unchunked(body)
    if digest is not None and digest.startswith("sha1:") and digest[5:] != base32_sha1(body):
        raise ValueError(f"{record_id}: the payload isn't what its digest says")
    return len(body), body


_HEAD = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "refers_to": pa.string(), "digest": pa.string()}
_WHOLE = {**_HEAD, "length": pa.int64(), "payload": pa.binary()}
_PART = {**_HEAD, "segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}


def _head(h: dict[str, str]) -> tuple:
    """The columns of ``_HEAD``: a continuation goes by the identifier of its origin."""
    own = h.get("warc-segment-origin-id", h["warc-record-id"])
    return own[1:-1], h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to", "")[1:-1] or None, h.get("warc-payload-digest")


def _table(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*rows)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, url, refers_to, digest, length, payload) of an archive's responses and revisits.

    ``payload`` is null and ``length`` that of the payload referred to where the record is a revisit.
    Whole records leave their file's task decoded; only those in segments are handed on, grouped and joined.
    Files may be compressed as a whole, record by record or not at all.  Records of other types are passed
    over; a block without an HTTP head is its own payload; other digests than SHA-1 are not verified.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = {"segment": "int", "total": "long", "block": "binary", "length": "long", "payload": "binary"}
    schemas = [", ".join(f"{name} {kinds.get(name, 'string')}" for name in names) for names in (_WHOLE, _PART)]

    def records(batches: Iterable[pa.RecordBatch], segmented: bool) -> Iterator[tuple[dict[str, str], bytes]]:
        for file in slices(batches, 1):
            data = file.column(0)[0].as_py()
            for h, block in parse(gzip.decompress(data) if data.startswith(_GZIP) else data):
                if ("warc-segment-number" in h) == segmented:
                    yield h, block

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for h, block in records(batches, False):
            if h["warc-type"] in PAGES:
                head = _head(h)
                digest = head[4] and head[4].removeprefix("sha1:")
                rows.append((*head[:4], digest, *_payload(head[0], head[1], head[4], None, block)))
                held += len(block)
            if held > 4 << 20:
                yield _table(rows, _WHOLE)
                rows, held = [], 0
        yield _table(rows, _WHOLE)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for h, block in records(batches, True):
            total = h.get("warc-segment-total-length")
            rows.append((*_head(h), int(h["warc-segment-number"]), total and int(total), block))
            held += len(block)
            if held > 4 << 20:
                yield _table(rows, _PART)
                rows, held = [], 0
        yield _table(rows, _PART)

    in_order = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = (
        files.mapInArrow(parts, schemas[1])
        .groupBy("record_id")
        .agg(
            F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"), F.max("url").alias("url"),
            F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.max("total").alias("total"),
            in_order.alias("parts"),
        )
        # A record without its first segment may be a page's, so it is an error.
        .filter(F.col("record_type").isNull() | F.col("record_type").isin(*PAGES))
        .withColumn("gaps", F.col("parts.segment") != F.sequence(F.lit(1), F.size("parts")))
        .select(
            "record_id", "record_type", "url", "refers_to", "digest",
            # A gap makes the length wrong, whatever the blocks add up to.
            F.when(F.col("gaps"), F.lit(-1).cast("long")).otherwise(F.coalesce("total", F.lit(-1).cast("long"))).alias("total"),
            F.concat_ws("", F.col("parts.block").cast("array<string>")).cast("binary").alias("block"),
        )
    )

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 6, 4 << 20):
            rows = []
            for r in part.to_pylist():
                head = [r[name] for name in _HEAD]
                digest = r["digest"] and r["digest"].removeprefix("sha1:")
                rows.append((*head[:4], digest, *_payload(r["record_id"], r["record_type"], r["digest"], r["total"], r["block"])))
            yield _table(rows, _WHOLE)

    return files.mapInArrow(whole, schemas[0]).unionByName(joined.mapInArrow(decode, schemas[0]))


def archive(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archive back; see ``read``."""
    spark = pages.sparkSession
    path = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least, segment)
    return read(spark, path)


def page_of(record_id: str):
    """The page number in the identifier of a record that ``write`` wrote; null where it wrote ``null``."""
    text = F.element_at(F.split(F.col(record_id), ":"), 3)
    return F.when(text != "null", text).cast("long")
