"""WARC archives with segmented records: writing, and reassembly by segment order.

An archive is a sequence of zstandard frames, one WARC/1.1 record in each, parted by an empty skippable
frame; any multi-frame zstandard reader sees one long WARC. The parting frame doubles as the record
delimiter of Spark's text source, so archives are written by Spark's own committer and read back in
splits, a record at a time, on any file system. A record whose frame would contain the delimiter is stored
as two frames.

The payload of a response is an HTTP body in chunked transfer framing. A block over ``segment_bytes`` is
split: the first segment is the response record (WARC-Segment-Number 1), the others are continuation
records that name its id, the last with the total length. Reading groups continuations by origin, orders them
by segment number, checks that none is missing and that the total length fits, removes the chunk framing and
verifies the payload's SHA-1. Equal payloads are stored once: the page with the largest id is the
response, the others are revisit records that refer to it.

A null html is an empty payload. Rows with a null page_id are archived and come back with a null id; they are
the response only if no page with an id has their payload. Rows that repeat a page_id are records of their own;
of equal largest ids, the later row is the response. Null urls give records without a target. No pages
give no rows; other columns are not archived. Reading expects this layout, one record between two parting frames.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

PART = b"P*M\x18\0\0\0\0"  # fixed value: an empty zstandard skippable frame
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, row: int) -> str:
    return f"<urn:page:{'' if page is None else page}:{row}>"


def page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return int(page) if page else None


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a block does not end where its length says")
    return fields, rest[:size]


def page_records(page: int | None, row: int, url: str | None, payload: bytes, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A page's records: a response in one or more segments, or a revisit."""
    name = record_id(page, row)
    target = None if url is None else "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    fields = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)], block)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)], part)


def frames(codec, data: bytes) -> bytes:
    """One zstandard frame, or several where one would contain the delimiter."""
    out = codec.compress(data)
    return out if PART not in out else frames(codec, data[: len(data) // 2]) + frames(codec, data[len(data) // 2 :])


def write_archives(pages: DataFrame, root: str, work: Workspace, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload")).withColumn("key", F.sha2("payload", 256))
    kept = rows.groupBy("key").agg(F.max(F.struct("page", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", F.col("first.page").alias("to_page"), F.col("first.row").alias("to_row"))
    kept = work.table(kept, "equal-payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3, write_checksum=True)
        for b in batches:
            out = []
            for page, row, url, payload, to_page, to_row in zip(*(b.column(c).to_pylist() for c in ("page", "row", "url", "payload", "to_page", "to_row")), strict=True):
                refers = None if to_row is None or to_row == row else record_id(to_page, to_row)
                out += [frames(codec, r) for r in page_records(page, row, url, payload, refers, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.join(kept, "key", "left").select("page", "row", "url", "payload", "to_page", "to_row").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", PART.decode()).text(root)


PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _finished(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """A whole response or revisit as a row."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}
    row = {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"]}
    if fields["warc-type"] == "revisit":
        return row | {"payload_bytes": int(http["content-length"]), "refers_to": page_of(fields["warc-refers-to"])}
    payload = unchunked(body) if http.get("transfer-encoding") == "chunked" else body
    if base32_sha1(payload) != row["payload_digest"]:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    return row | {"payload_bytes": len(payload), "refers_to": None, **({"payload": payload} if with_payload else {})}


def _unframed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()


def read_archives(spark: SparkSession, root: str, with_payload: bool = False, report: bool = False) -> DataFrame:
    """A row per response or revisit of the archives under ``root``; the payload too if asked for.

    A record that cannot be read, a missing or orphan segment, a wrong total length or digest fails the job; with
    ``report`` each gives a row of record_type ``damaged`` instead, with what is wrong in ``problem``.
    """
    schema = PAGE + ", problem string" + ", payload binary" * with_payload

    def damaged(problem: Exception, origin: str | None = None) -> dict:
        if not report:
            raise problem
        return {"record_type": "damaged", "problem": f"{origin}: {problem}" if origin else str(problem)}

    stored = spark.read.option("lineSep", PART.decode()).text(root).select(F.col("value").cast("binary").alias("frame"))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("frame", pa.binary()), *ARROW, *[("payload", pa.binary())] * with_payload])
        for b in batches:
            out = []
            for frame in b.column(0).to_pylist():
                try:
                    fields, block = parse_record(_unframed(frame))
                    if "warc-segment-number" in fields:
                        out.append({"origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]), "segment": int(fields["warc-segment-number"]), "frame": frame})
                    elif fields["warc-type"] in ("response", "revisit"):
                        out.append(_finished(fields, block, with_payload))
                except DAMAGE as e:
                    out.append(damaged(e))
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([*ARROW, *[("payload", pa.binary())] * with_payload])
        origin, parts, first, total, missing, due = None, [], {}, None, 0, 1

        def whole() -> dict:
            try:
                block = b"".join(parts)
                if missing:
                    raise ValueError(f"segment {missing} is missing")
                if total != len(block):
                    raise ValueError("segments do not add up to the total length")
                return _finished(first, block, with_payload)
            except DAMAGE as e:
                return damaged(e, origin)

        for b in batches:
            out = []
            for at, segment, frame in zip(*(b.column(c).to_pylist() for c in ("origin", "segment", "frame")), strict=True):
                if at != origin:
                    if origin is not None:
                        out.append(whole())
                    origin, parts, first, total, missing, due = at, [], {}, None, 0, 1
                fields, block = parse_record(_unframed(frame))
                missing, due = missing or (due if segment != due else 0), segment + 1
                if segment == 1:
                    first = fields
                if not missing:
                    parts.append(block)
                total = int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else total
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        if origin is not None:
            yield pa.RecordBatch.from_pylist([whole()], schema=kind)

    # Whole records end in the first pass, segments go to their origin still compressed
    parsed = Workspace(spark, "warc-records").table(stored.mapInArrow(sort_out, f"origin string, segment int, frame binary, {schema}"), "parsed")
    whole = parsed.where("origin is null").drop("origin", "segment", "frame")
    parts = parsed.where("origin is not null").select("origin", "segment", "frame").repartition("origin").sortWithinPartitions("origin", "segment")
    return whole.unionByName(parts.mapInArrow(reassemble, schema))


DAMAGE = (ValueError, KeyError, IndexError, EOFError, zstandard.ZstdError)
ARROW = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string())]


def archive_pages(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    work = Workspace(pages.sparkSession, "warc")
    write_archives(pages, work.path("archives"), work, segment_bytes)
    return read_archives(pages.sparkSession, work.path("archives"))
