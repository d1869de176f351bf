"""WARC archives as seekable Zstandard bundles.

Pages become WARC/1.1 records: one response per distinct payload, revisits for its other pages. Each
task writes its rows as bundles (``*.warc.zst``): a run of records is an independent frame, and a seek table in
a skippable frame at the end gives every frame's compressed and plain size, so any frame can be
read alone. The index table maps every record id to (bundle, frame, offset in the frame, length).

A bundle's name is new for every attempt and only the index of attempts that were committed names it, so
a lost or repeated task leaves a file that nothing refers to, never a wrong one. Readers use
the bundles of the index alone.

Bundles are written through ``pyarrow.fs`` to the folder given (a URI that every executor reaches) and read with
Spark's binary files.

Defined results: null html is an empty payload, null urls become urn:page:<id>; rows that repeat both id and
payload are all responses where theirs is the largest id; an empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.frames import joined, sliced
from lectern.plans.sizing import staged

FRAME_BYTES = 1 << 20  # plain bytes after which a frame is closed
BUNDLE_BYTES = 16 << 20  # compressed bytes after which a bundle is closed
LEVEL = 3
MIN_PAYLOAD = 0  # payloads shorter than this are never made revisits
DATE = "2000-01-01T00:00:00Z"  # of all records unless the caller gives another: archives are reproducible
# Fixed values of the seekable format: a skippable frame's magic, the footer's magic, the footer's size.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9

INDEX = ("page_id bigint, record_id string, bundle string, frame int, offset bigint, length bigint")
READ = ("bundle string, frame int, offset bigint, record_id string, page_id bigint, record_type string, "
        "refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def _uri(url: str | None, page_id: int | None) -> str:
    """The URL without characters that would break a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record. ``refers_to``: the page whose response has the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("X-Refers-To-Page", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``offset``; checks the block's digest."""
    head_end = data.index(b"\r\n\r\n", offset)
    lines = data[offset:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {offset}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    begin = head_end + 4
    end = begin + int(fields["Content-Length"])
    block = data[begin:end]
    if data[end : end + 4] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record at {offset}")
    return fields, block, end + 4


class Bundle:
    """Collects records; gives frames and, when closed, the whole file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.packed_bytes = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        place = len(self.frames), self.open_bytes
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_bytes))
            self.packed_bytes += len(packed)
            self.open, self.open_bytes = [], 0

    def content(self) -> bytes:
        self.close_frame()
        return b"".join(self.frames) + seek_table(self.sizes)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer frame: sizes of every frame, their number, a descriptor without checksums, the magic number."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return (struct.pack("<II", SKIPPABLE, len(entries) + FOOTER) + entries
            + struct.pack("<IBI", len(sizes), 0, SEEKABLE))


def frame_places(tail: bytes) -> list[tuple[int, int, int]]:
    """(begin, packed size, plain size) of every frame, from a file's last bytes (at least its seek table)."""
    number, descriptor, magic = struct.unpack("<IBI", tail[-FOOTER:])
    if magic != SEEKABLE or descriptor & 0x80:
        raise ValueError("no seek table of this kind")
    table = tail[len(tail) - FOOTER - 8 * number : len(tail) - FOOTER]
    places, at = [], 0
    for i in range(number):
        packed, plain = struct.unpack_from("<II", table, 8 * i)
        places.append((at, packed, plain))
        at += packed
    return places


def read_record(uri: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, reading the footer and its frame only."""
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        number = struct.unpack("<I", f.read_at(4, size - FOOTER))[0]
        table = FOOTER + 8 * number
        begin, packed, plain = frame_places(f.read_at(table, size - table))[frame]
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, begin), max_output_size=plain)
    fields, block, _ = parsed(data, offset)
    return fields, block


def _with_references(pages: DataFrame, min_payload: int) -> DataFrame:
    """page_id, url, payload and, for revisits, refers_to: the largest id that has the same payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    # the digest of a payload joins on; the payload itself is never shuffled for it
    prints = staged(
        rows.where(F.length("payload") >= min_payload).select("page_id", F.unhex(F.sha2("payload", 256)).alias("print")), "prints")
    largest = prints.groupBy("print").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = staged(
        joined(prints, largest, ["print"], "inner").where("page_id < refers_to OR page_id IS NULL AND refers_to IS NOT NULL")
        .select("page_id", "print", "refers_to").distinct(), "revisits")
    found = joined(rows.withColumn("print", F.unhex(F.sha2("payload", 256))), revisits, ["page_id", "print"], "left",
                   revisits.count())
    return found.drop("print")


def write_bundles(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles under ``folder``; the index, written to the shared folder."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(path, recursive=True)
        bundle, name, rows = Bundle(frame_bytes), uuid.uuid4().hex, []

        def closed() -> pa.RecordBatch:
            with system.open_output_stream(f"{path}/{name}.warc.zst", compression=None) as out:
                out.write(bundle.content())
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in sliced(batches, 64):
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(page, url, payload, refers_to, date)
                frame, offset = bundle.add(data)
                rows.append({"page_id": page, "record_id": record_id(page), "bundle": f"{name}.warc.zst", "frame": frame,
                             "offset": offset, "length": len(data)})
                if bundle.packed_bytes >= bundle_bytes:
                    yield closed()
                    bundle, name, rows = Bundle(frame_bytes), uuid.uuid4().hex, []
        if rows:
            yield closed()

    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()),
                        ("offset", pa.int64()), ("length", pa.int64())])
    source = _with_references(pages, min_payload).select("page_id", "url", "payload", "refers_to")
    return staged(source.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the index's bundles, as parsed from the archives; ``payload`` is null unless asked for.

    Fails if a record of the index isn't where it says, or the other way round.
    """
    spark = index.sparkSession
    read_schema = pa.schema([
        ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("record_id", pa.string()),
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary())])

    def row(name: str, frame: int, offset: int, fields: dict[str, str], block: bytes) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        revisit = fields["WARC-Type"] == "revisit"
        sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != size or digest(payload) != sha1):
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
        return {
            "bundle": name, "frame": frame, "offset": offset, "record_id": fields["WARC-Record-ID"][1:-1],
            "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, "record_type": fields["WARC-Type"],
            "refers_to": int(fields["X-Refers-To-Page"]) if revisit else None, "payload_bytes": size,
            "payload_digest": sha1, "payload": payload if payloads and not revisit else None}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            name = batch.column(0)[0].as_py().rsplit("/", 1)[-1]
            content = memoryview(batch.column(1)[0].as_buffer())
            for frame, (begin, packed, plain) in enumerate(frame_places(content)):
                data = zstandard.ZstdDecompressor().decompress(content[begin : begin + packed], max_output_size=plain)
                rows, at = [], 0
                while at < len(data):
                    fields, block, end = parsed(data, at)
                    rows.append(row(name, frame, at, fields, block))
                    at = end
                yield pa.RecordBatch.from_pylist(rows, read_schema)

    if index.isEmpty():
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    records = files.mapInArrow(read, READ)
    wanted = index.select(*[F.col(c).alias(f"i_{c}") for c in ("bundle", "frame", "offset", "record_id")])
    known = index.select("bundle").distinct()
    found = records.join(known, "bundle", "left_semi").join(
        wanted, (F.col("bundle") == F.col("i_bundle")) & (F.col("frame") == F.col("i_frame"))
        & (F.col("offset") == F.col("i_offset")), "full")
    wrong = F.raise_error(F.concat(F.lit("index and archive differ at "), F.coalesce("bundle", "i_bundle")))
    agree = F.col("record_id").eqNullSafe(F.col("i_record_id"))
    return found.withColumn("bundle", F.when(agree, F.col("bundle")).otherwise(wrong)).select(*records.columns)
