"""WARC archives as seekable Zstandard bundles.

Records are gathered into frames that decompress on their own; a footer in a skippable
frame lists the frames' sizes (the published seek table format), and an index maps each record's identifier to its archive,
frame and offset in the frame. Equal payloads are stored once, as a response; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Workspace, column, sized_join

#: A frame is closed when its records have so many bytes.
FRAME = 1 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _number(urn: str | None) -> int | None:
    return int(x) if urn and (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one does. A response's payload is held against its digest."""
    end = data.index(b"\r\n\r\n", at)
    head = _fields(data[at:end])
    begin, size = end + 4, int(head["content-length"])
    block = data[begin : begin + size]
    if head["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response":
        payload_bytes, digest_found = len(payload), base32_sha1(payload)
        if digest_found != digest:
            raise ValueError(f"damaged payload {head['warc-record-id']}")
    else:
        payload_bytes, payload = int(_fields(http)["content-length"]), None
    return {"page_id": _number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload": payload, "payload_bytes": payload_bytes, "payload_digest": digest, "record_type": kind, "refers_to": _number(head.get("warc-refers-to"))}, begin + size + 4


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class Bundle:
    """An archive being written. ``add`` returns the record's frame and offset there."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frame, self.size, self.table = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > FRAME:
            self.flush()
        spot = len(self.table), self.size
        self.frame.append(record)
        self.size += len(record)
        return spot

    def flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.sink.write(packed)
            self.table.append((len(packed), self.size))
            self.frame, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(begin, packed size, size) of each frame, from the footer."""
    total = source.size()
    source.seek(total - 9)
    frames, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if descriptor & 0x80 else 8
    source.seek(total - 9 - frames * each)
    data, out, at = source.read(frames * each), [], 0
    for i in range(frames):
        packed, size = struct.unpack_from("<II", data, i * each)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(source, spot: tuple[int, int, int]) -> bytes:
    import zstandard

    source.seek(spot[0])
    return zstandard.ZstdDecompressor().decompress(source.read(spot[1]), max_output_size=spot[2])


def read_record(archive: str, frame: int, offset: int) -> dict:
    """One record by its place, decompressing its frame alone."""
    fs, path = _open(archive)
    with fs.open_input_file(path) as source:
        return parse_record(read_frame(source, seek_table(source)[frame]), offset)[0]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"  # the index names what a finished attempt wrote
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}", compression=None) as sink:
            bundle = Bundle(sink)
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    page, url, html, refers = (c[i].as_py() for c in batch.columns)
                    rows.append((page, f"{folder}/{name}", *bundle.add(make_record(page, url, html or b"", refers))))
                cols = [*zip(*rows, strict=True)] or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["page_id", "archive", "frame", "offset"])
            bundle.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every row as a record, an archive for each partition; rows page_id, archive, frame, offset (lazy: the archives are written when it is).

    The payload is the html in UTF-8; null and empty ones are empty. Of equal payloads of ``least_bytes`` or more the smallest identifier is a
    response and the others revisits; rows that repeat that identifier are responses too. Null identifiers: responses if no other row has the payload.
    Null urls leave the field out. No rows: no rows. Other columns aren't read.
    """
    given = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), F.coalesce(column(pages, html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    given = given.withColumns({"sha": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    same = given.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(f"n > 1 and size >= {least_bytes}").drop("n")
    marked = sized_join(given, same, ["sha", "size"], "left")
    marked = marked.select("page_id", "url", "html", F.expr("if(page_id <=> first, null, first)").alias("refers_to"))
    return marked.mapInArrow(_write(folder), "page_id bigint, archive string, frame int, offset bigint")


RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, frame int, offset bigint"


def _read(payloads: bool):
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = _open(archive)
                with fs.open_input_file(path) as source:
                    for i, spot in enumerate(seek_table(source)):
                        data, at, rows = read_frame(source, spot), 0, []
                        while at < len(data):
                            record, after = parse_record(data, at)
                            if not payloads:
                                record["payload"] = None
                            rows.append((*record.values(), archive, i, at))
                            at = after
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in column ``archive``: RECORD, each with its frame and offset. A revisit's payload is null."""
    names = archives.select("archive").distinct()
    n = max(1, names.count())
    return names.repartitionByRange(n, "archive").mapInArrow(_read(payloads), RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    index = ws.keep(write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), ws.path("archives")), "index")
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') as x from pages
), q as (
  select page_id, strlen(x) as payload_bytes, sha1(x) as hex, min(page_id) over (partition by x) as first from p
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((
    (16 * (strpos('0123456789abcdef', substr(hex, cast(1 + (5 * i) // 4 as bigint), 1)) - 1) + strpos('0123456789abcdef', substr(hex, cast(2 + (5 * i) // 4 as bigint), 1)) - 1)
    >> cast(3 - (5 * i) % 4 as bigint)) & 31) as bigint), 1)), '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from first then null else first end as refers_to
from q
"""
