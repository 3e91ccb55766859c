"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of bounded size, frames into bundles; a
bundle ends with the seek table of the Zstandard seekable format (a skippable frame that
lists the compressed and plain size of each frame).  An index table maps every record
to its bundle, frame, and offset and length inside the plain frame, so that one record
costs one small read, and a bundle can be read in parallel or from start to end.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
largest id is stored whole and the others as revisits of it.

Bundles are written by the tasks under names of their own; readers go by the index, which
Spark commits, so a repeated or lost task leaves at most an unused file.

Defined results: a null payload is empty, a null URL has no target header, line breaks
and blanks in URLs are percent-encoded.  Repeated rows of the largest id are all stored
whole.  A null id sorts below all others and is written as ``null``.  An empty table
writes no bundle and reads back empty.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.sizing import cut_lineage, join_by_size, shared_folder
from tabloom.llm.ship import ship

REVISIT_BYTES = 1000
# Plain bytes after which a frame ends, compressed bytes after which a bundle ends.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
# Plain bytes of frames that a task reads back.
TASK_BYTES = 64 << 20
LEVEL = 1
# Fixed values of the seekable format and of the records.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ID = "urn:x-record:"

INDEX = "record_id string, bundle string, frame int, offset int, length int"
RECORDS = (
    "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
)


def roles(pages: DataFrame, page_id: str, payload: str, url: str | None, least: int = REVISIT_BYTES):
    """``id, url, payload, digest, bytes, refers_to`` (null for whole records)."""
    rows = pages.select(
        F.col(page_id).alias("id"),
        (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    whole = (
        rows.filter(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.max("id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.col("digest").alias("d"), "first_id")
    )
    # Only digests that occur again are joined; a known small number of them leaves the
    # payloads where they are.
    whole = cut_lineage(whole)
    on = (F.col("digest") == F.col("d")) & (F.col("bytes") >= least)
    joined = join_by_size(rows, whole, on, "left", whole.count())
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "digest",
        "bytes",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _target(url: str) -> str:
    return "".join(c if "!" <= c else f"%{ord(c):02X}" for c in url)


def record(name: str, url: str | None, payload: bytes | None, digest: str, size: int, refers: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    if refers is not None:
        head += [f"WARC-Refers-To: <{ID}{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle, from ``(compressed, plain)`` sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Writer:
    """Cuts a stream of records into frames and bundles below a folder."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.out = None
        self.index: list[tuple] = []
        self._open_frame()

    def _open_frame(self) -> None:
        self.records: list[bytes] = []
        self.names: list[str] = []
        self.size = 0

    def add(self, name: str, data: bytes) -> None:
        if self.records and self.size + len(data) > self.frame_bytes:
            self._end_frame()
        self.names.append(name)
        self.records.append(data)
        self.size += len(data)

    def _end_frame(self) -> None:
        if not self.records:
            return
        if self.out is None:
            self.bundle = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            files, path = pa.fs.FileSystem.from_uri(self.bundle)
            self.out = files.open_output_stream(path, compression=None)
            self.frames: list[tuple[int, int]] = []
            self.written = 0
        packed = self.packer.compress(b"".join(self.records))
        self.out.write(packed)
        at = 0
        for name, data in zip(self.names, self.records):
            self.index.append((name, self.bundle, len(self.frames), at, len(data)))
            at += len(data)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self._open_frame()
        if self.written >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        self._end_frame()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None

    def take(self) -> pa.RecordBatch | None:
        """Index rows of finished bundles."""
        if not self.index or self.out is not None:
            return None
        columns, self.index = list(zip(*self.index)), []
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class Bundle:
    """Frames of one bundle, found by its seek table."""

    def __init__(self, uri: str):
        files, path = pa.fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        width = 12 if flags & 0x80 else 8
        table = self._read(end - 9 - count * width, count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.unpacker.decompress(self._read(at, packed), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset behind it."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = head_end + 4
    end = start + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return head, data[start:end], end + 4


def _name(uri: str) -> str:
    return uri.strip("<>").removeprefix(ID)


def described(head: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORDS`` of one record; whole payloads are digested anew."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head["WARC-Type"]
    stated = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "revisit":
        size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        return _name(head["WARC-Record-ID"]), kind, _name(head["WARC-Refers-To"]), size, stated
    found = hashlib.sha1(payload).hexdigest()
    if found != stated:
        raise ValueError(f"digest of {head['WARC-Record-ID']} does not fit")
    return _name(head["WARC-Record-ID"]), kind, None, len(payload), found


def write(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    payload: str = "html",
    url: str | None = "url",
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write the bundles below ``folder`` (shared storage) and return the index, which
    lies as a table in ``<folder>/index``."""
    from urllib.parse import urlsplit

    ship(pages.sparkSession)

    files, path = pa.fs.FileSystem.from_uri(folder if urlsplit(folder).scheme else f"file://{folder}")
    files.create_dir(path, recursive=True)
    base = folder if urlsplit(folder).scheme else f"file://{folder}"

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(base, frame_bytes, bundle_bytes)
        for batch in batches:
            columns = [batch[n] for n in ("id", "url", "payload", "digest", "bytes", "refers_to")]
            for row in zip(*columns):
                name, link, body, digest, size, refers = (x.as_py() for x in row)
                name = "null" if name is None else str(name)
                refers = None if refers is None else str(refers)
                writer.add(name, record(name, link, body, digest, size, refers))
                if writer.out is None and (done := writer.take()) is not None:
                    yield done
        writer.close()
        if (done := writer.take()) is not None:
            yield done

    rows = roles(pages, page_id, payload, url)
    rows.mapInArrow(bundles, INDEX).write.parquet(f"{base}/index")
    return pages.sparkSession.read.parquet(f"{base}/index")


def read(index: DataFrame) -> DataFrame:
    """``RECORDS`` of every record of the index's bundles, frame by frame.

    Frames are dealt to tasks of about ``TASK_BYTES`` plain bytes, neighbours together.
    """
    ship(index.sparkSession)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        bundle, held = None, None
        try:
            for batch in batches:
                for uri, number in zip(batch["bundle"].to_pylist(), batch["frame"].to_pylist()):
                    if uri != held:
                        if bundle is not None:
                            bundle.close()
                        bundle, held = Bundle(uri), uri
                    data, at, rows = bundle.frame(number), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        rows.append(described(head, block))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        finally:
            if bundle is not None:
                bundle.close()

    frames = index.groupBy("bundle", "frame").agg(F.sum("length").alias("bytes"))
    size = frames.agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes")).first()
    # Tasks by the plain bytes to read, not by the few bytes that name a frame.
    wanted = max(-(-(size["bytes"] or 0) // TASK_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, min(size["frames"], wanted))
    together = max(1, size["frames"] // (4 * tasks))
    dealt = frames.repartition(tasks, "bundle", F.floor(F.col("frame") / together))
    return dealt.sortWithinPartitions("bundle", "frame").select("bundle", "frame").mapInArrow(records, RECORDS)


def fetch(index: DataFrame, ids: list[str]) -> list[tuple[dict[str, str], bytes]]:
    """Single records by id, one frame read each: the use of the index."""
    out = []
    for row in index.filter(F.col("record_id").isin(ids)).collect():
        bundle = Bundle(row["bundle"])
        data = bundle.frame(row["frame"])
        bundle.close()
        head, block, end = parse(data, row["offset"])
        if end - row["offset"] != row["length"]:
            raise ValueError("the index does not fit the bundle")
        out.append((head, block))
    return out


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``page_id, url, html`` to the shared folder and read the archives back."""
    index = write(pages, shared_folder(spark, "warc"))
    back = read(index)
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    return back.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
