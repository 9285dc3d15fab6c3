"""WARC archives in seekable Zstandard bundles, written and read by Spark tasks.

Each task writes its share of the pages as records. Records are gathered into
frames of about ``frame_bytes``, each an independent Zstandard frame, and frames
into bundles of about ``bundle_bytes``. A bundle ends with a seek table, a skippable
frame that lists the sizes of all frames, so any plain decompressor reads a bundle
whole and a reader that knows the table reads single frames. The index maps a record
id to its bundle, frame and offset within the frame.

Of equal payloads (same SHA-256) of at least ``revisit_from`` bytes the record with
the smallest id is a response, the others are revisits that refer to it and hold no
payload. Smaller payloads are always responses.

Bundle names are unique to a task attempt and only the index of finished attempts
counts, so failed and repeated tasks leave nothing that is read.

Defined results: a NULL payload counts as empty; a NULL id loses against a number and
is itself archived; rows repeated with id and payload are all responses if theirs is
the smallest id; a NULL url writes no target field; line breaks within a url are
written percent-encoded; an empty table gives an archive without bundles; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import over_batches
from pageloom.session import work_dir, written

MOST_TASKS = 1 << 16  # that a single read is dealt out to
# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = (
    "record_id string, page_id long, bundle string, frame int, offset long, length long"
)
RECORD_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


@dataclass(frozen=True)
class Archive:
    folder: str
    index: DataFrame


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark resolves it by, so that executors write the
    bundles where Spark writes the index."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified folder, and its path there."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, url: str | None, sha1: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha1} {url}')}"


def _record(page_id, url, payload: bytes, first_id, first_url, date: str) -> tuple[str, bytes]:
    """Name and bytes of one record; ``first_id`` is set for revisits."""
    sha1 = digest(payload)
    name = record_name(page_id, url, sha1)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = first_id is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if url is not None:
        safe = url.replace("\r", "%0D").replace("\n", "%0A")
        fields.append(("WARC-Target-URI", safe))
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<{record_name(first_id, first_url, sha1)}>"),
            ("Refers-To-Page-Id", str(first_id)),
        ]
    block = http if revisit else http + payload
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


class _Bundle:
    """One file: frames, then the seek table."""

    def __init__(self, folder: str, level: int):
        store, root = _store(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.written = 0

    def frame(self, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.sizes.append((len(packed), len(plain)))
        self.written += len(packed)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *pair) for pair in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)))
        self.out.write(entries + footer)
        self.out.close()


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, frame, rows = None, bytearray(), []

        def flush():
            """Index rows of the open frame, which is written."""
            nonlocal frame, rows
            bundle.frame(bytes(frame))
            out = pa.RecordBatch.from_pylist(rows, INDEX_ARROW)
            frame, rows = bytearray(), []
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, first_id, first_url = (c[i].as_py() for c in batch.columns)
                name, record = _record(page_id, url, html or b"", first_id, first_url, date)
                if bundle is None:
                    bundle = _Bundle(folder, level)
                rows.append(
                    {
                        "record_id": name,
                        "page_id": page_id,
                        "bundle": bundle.name,
                        "frame": len(bundle.sizes),
                        "offset": len(frame),
                        "length": len(record),
                    }
                )
                frame += record
                if len(frame) >= frame_bytes:
                    yield flush()
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if rows:
            yield flush()
        if bundle is not None:
            bundle.close()

    return write


INDEX_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
RECORD_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def with_response(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_from: int
) -> DataFrame:
    """page_id, url, payload and, for revisits, id and url of the response."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    # Aggregated by a narrow digest, copies within a task first.
    first = rows.groupBy("same").agg(
        F.min_by(F.struct("page_id", "url"), F.coalesce("page_id", F.lit(2**63 - 1))).alias("first")
    )
    revisit = (F.octet_length("payload") >= revisit_from) & F.col("first.page_id").isNotNull()
    revisit &= ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.join(first, "same").select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, F.col("first.page_id")).alias("first_id"),
        F.when(revisit, F.col("first.url")).alias("first_url"),
    )


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = 0,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 64 << 20,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """Writes bundles and index below ``folder``, by default in the shared work folder."""
    folder = qualified(pages.sparkSession, folder or f"{work_dir(pages.sparkSession)}/warc")
    store, root = _store(folder)
    store.create_dir(f"{root}/bundles", recursive=True)
    rows = with_response(pages, id_col, url_col, payload_col, revisit_from)
    writer = _writer(f"{folder}/bundles", frame_bytes, bundle_bytes, level, date)
    index = over_batches(rows, writer, INDEX_SCHEMA)
    return Archive(folder, written(index, f"{folder}/index"))


def seek_table(source) -> list[tuple[int, int, int]]:
    """(file offset, packed size, plain size) of each frame of an open bundle."""
    end = source.size()
    source.seek(end - 9)
    count, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if descriptor & 0x80 else 8
    source.seek(end - 9 - width * count)
    raw, at, frames = source.read(width * count), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        frames.append((at, packed, plain))
        at += packed
    return frames


def _frame(source, where: tuple[int, int, int]) -> bytes:
    at, packed, plain = where
    source.seek(at)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at`` and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or digest(payload) != sha1):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page_id, refers_to = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "page_id": None if page_id is None else int(page_id),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers_to is None else int(refers_to),
        "payload_bytes": length,
        "payload_digest": sha1,
        "payload": None if revisit else payload,
    }, end + 4 + size + 4


def _reader(folder: str, payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{bundle}") as source:
                    for where in seek_table(source):
                        data, at, rows = _frame(source, where), 0, []
                        while at < len(data):
                            record, at = parse_record(data, at)
                            rows.append(record if payload else record | {"payload": None})
                        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    return read


def read_archive(archive: Archive, payload: bool = True) -> DataFrame:
    """All records, bundle by bundle and frame by frame; digests are checked."""
    bundles = archive.index.select("bundle").distinct()
    # A name is a few bytes but a bundle much work, so each is a task of its own.
    bundles = bundles.repartition(max(1, min(bundles.count(), MOST_TASKS)))
    return over_batches(bundles, _reader(f"{archive.folder}/bundles", payload), RECORD_SCHEMA)


def _fetcher(folder: str):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, source, frames, at, data = None, None, [], None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if source is not None:
                        source.close()
                    name, at = row["bundle"], None
                    source = store.open_input_file(f"{root}/{name}")
                    frames = seek_table(source)
                if row["frame"] != at:
                    at, data = row["frame"], _frame(source, frames[row["frame"]])
                yield pa.RecordBatch.from_pylist([parse_record(data, row["offset"])[0]], RECORD_ARROW)
        if source is not None:
            source.close()

    return fetch


def fetch_records(archive: Archive, wanted: DataFrame) -> DataFrame:
    """Random access: the records whose record_id is in ``wanted``. Of their bundles the seek
    tables are read, and each frame that holds one, once for each task."""
    rows = archive.index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    rows = rows.dropDuplicates(["record_id"]).select("bundle", "frame", "offset")
    frames = rows.select("bundle", "frame").distinct().count()
    rows = rows.repartition(max(1, min(frames, MOST_TASKS)), "bundle", "frame")
    rows = rows.sortWithinPartitions("bundle", "frame", "offset")
    return over_batches(rows, _fetcher(f"{archive.folder}/bundles"), RECORD_SCHEMA)
