"""Operator 7, WARC: a PySpark data source that writes and reads web archives.

Writing: each task writes one gzip-per-record archive; the commit writes a manifest of the files
of successful tasks, so the files of failed or duplicated attempts never count.

Reading: the driver plans file partitions from the manifest (or a listing). A task parses a
record's header first; record-type and header predicates that Spark pushes down are tested on
it, and the payload of an unwanted record, or of one whose payload columns are not asked for, is
skipped without decoding.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import bounded_batches, new_path, staged

SCHEMA = "page_id long, url string, record_id string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Columns that come from the header: predicates on these are tested before the payload is read.
HEADER_COLUMNS = ("page_id", "url", "record_id", "record_type", "refers_to", "payload_digest", "payload_bytes")
MANIFEST = "_manifest.json"
#: Compressed bytes read at a time.
CHUNK, HEAD = 1 << 20, 16 << 10


def filesystem(path: str):
    """An Arrow filesystem and the path in it: file://, hdfs:// and object stores; a bare path is local."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1, as WARC-Payload-Digest has it after ``sha1:``."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records --------------------------------------------------------------------------------------
def record_bytes(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record, as a gzip member of its own that states its length.

    The header deflates in a block that ends at a byte boundary, so that a reader can decode it
    without touching the payload; the ``sl`` extra field of the WARC standard's gzip annex has
    the member's compressed and uncompressed sizes, so that it can step over the rest.
    """
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n"
    plain = head.encode() + payload + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(head.encode()) + z.flush(zlib.Z_SYNC_FLUSH) + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()
    total = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + struct.pack("<IBBH", 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def stated_length(member: bytes) -> int:
    """The member's length from its ``sl`` field; 0 where it has none."""
    if len(member) >= 24 and member[:3] == b"\x1f\x8b\x08" and member[3] & 4:
        size = struct.unpack_from("<H", member, 10)[0]
        at = 12
        while at + 4 <= min(12 + size, len(member)):
            n = struct.unpack_from("<H", member, at + 2)[0]
            if member[at : at + 2] == b"sl" and n == 8:
                return struct.unpack_from("<I", member, at + 4)[0]
            at += 4 + n
    return 0


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class Records:
    """Iterates over an archive's records: (header, payload or None).

    ``wanted(header)`` decides on the header alone; ``payloads`` whether payloads are read at
    all. An unread payload is stepped over by its member's stated length; in archives of other
    writers, which may not state it, it is inflated and thrown away. ``file`` can seek.
    """

    def __init__(self, file, size: int, wanted=lambda header: True, payloads: bool = True):
        self.file, self.size, self.wanted, self.payloads = file, size, wanted, payloads
        self.stepped = self.decoded = 0

    def __iter__(self):
        at = 0
        while at < self.size:
            self.file.seek(at)
            data = self.file.read(min(HEAD, self.size - at))
            length, read = stated_length(data), len(data)
            z, head = zlib.decompressobj(31), b""
            while b"\r\n\r\n" not in head:
                if not data:
                    data = self.file.read(CHUNK)
                    read += len(data)
                    if not data:
                        raise ValueError("the archive ends within a record's header")
                # a little at a time: the payload's deflate blocks stay untouched until they are wanted
                head += z.decompress(data, 1024)
                data = z.unconsumed_tail
            block, _, rest = head.partition(b"\r\n\r\n")
            header = parse_header(block)
            wanted = self.wanted(header)
            take = wanted and self.payloads
            if not take and length:
                self.stepped += 1
                at += length
            else:
                self.decoded += 1
                kept = [rest]
                while not z.eof:
                    if not data:
                        data = self.file.read(CHUNK)
                        read += len(data)
                        if not data:
                            raise ValueError("the archive ends within a record")
                    more = z.decompress(data, CHUNK)
                    data = z.unconsumed_tail
                    if take:
                        kept.append(more)
                at += read - len(z.unused_data)
            if wanted:
                yield header, b"".join(kept)[: int(header["content-length"])] if take else None


def headers_of(row: dict) -> list[tuple[str, str]]:
    out = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Payload-Length", str(row["payload_bytes"])),
    ]
    if row["page_id"] is not None:
        out.append(("X-Page-ID", str(row["page_id"])))
    if row["url"] is not None:
        # control characters must not break a header line
        out.append(("WARC-Target-URI", quote(row["url"], safe="".join(map(chr, range(0x20, 0x25))) + "".join(map(chr, range(0x26, 0x7F))))))
    if row["record_type"] == "revisit":
        out += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(row["refers_to"]))]
    return out


def row_of(header: dict[str, str]) -> dict:
    from urllib.parse import unquote

    number = lambda k: int(header[k]) if k in header else None
    return {
        "page_id": number("x-page-id"),
        "url": unquote(header["warc-target-uri"]) if "warc-target-uri" in header else None,
        "record_id": header.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">"),
        "record_type": header.get("warc-type"),
        "refers_to": number("x-refers-to-page-id"),
        "payload_digest": header.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_bytes": number("x-payload-length") if "x-payload-length" in header else number("content-length"),
    }


# ---- the data source ------------------------------------------------------------------------------
class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path.rstrip("/"), schema.fieldNames()
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.tests.append((column, (f.value,)))
            elif column in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((column, tuple(f.value)))
            elif column in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.path)
        from pyarrow.fs import FileSelector, FileType

        if fs.get_file_info(f"{path}/{MANIFEST}").type == FileType.File:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                names = json.loads(f.read())
        else:
            names = sorted(x.base_name for x in fs.get_file_info(FileSelector(path)) if x.type == FileType.File and x.base_name.endswith((".warc.gz", ".warc")))
        return [ArchivePartition(f"{self.path}/{name}") for name in names] or [ArchivePartition("")]

    def read(self, partition):
        if not partition.value:
            return
        fs, path = filesystem(partition.value)
        kept = {}

        def wanted(header):
            row = row_of(header)
            ok = all(row[c] is not None and (values is None or row[c] in values) for c, values in self.tests)
            kept["row"] = row
            return ok

        payloads = "payload" in self.names
        with fs.open_input_file(path) as file:
            rows, held = [], 0
            for _, payload in Records(file, file.size(), wanted, payloads):
                rows.append(kept["row"] | {"payload": payload})
                held += len(payload or b"")
                if len(rows) >= 1000 or held >= 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names], names=self.names)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator):
        fs, path = filesystem(self.path)
        rows = iter(iterator)
        first = next(rows, None)
        if first is None:
            return Written(None)
        fs.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"  # an attempt's own file
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
            while first is not None:
                row = first.asDict()
                payload = bytes(row["payload"] or b"")
                row |= {"record_id": str(uuid.uuid4()), "payload_digest": digest_of(payload), "payload_bytes": len(payload)}
                f.write(record_bytes(headers_of(row), b"" if row["record_type"] == "revisit" else payload))
                first = next(rows, None)
        return Written(name)

    def commit(self, messages):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages):
        fs, path = filesystem(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- the operator ------------------------------------------------------------------------------------
def archive_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """The records to write for (page_id, url, html): types, digests and referred pages.

    Of pages with equal payloads of at least ``min_revisit_bytes``, the smallest page_id is the
    response and the others revisit it. The digests meet in one aggregation with partial sums;
    only rows of a digest that comes more than once look their first page up.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    slim = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    firsts = slim.where(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha1", "first")
    # stored, its size is known: below the session's broadcast threshold payloads are not shuffled,
    # above it they are, and a digest with very many pages is split as a skewed one
    known = rows.join(staged(firsts, "warc-firsts"), "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        "payload",
    )


def round_trip(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Writes one record per row of (page_id, url, html) to ``path`` and reads the archives back.

    ``path`` defaults to a new folder in the shared folder. Returns the data source's columns
    (SCHEMA), or those named by ``columns``; of a revisit, payload_bytes and payload_digest
    are those of the full payload, and the stored payload is empty.

    A null html is an empty payload; a null url stays null; empty payloads are payloads like any
    other (with ``min_revisit_bytes`` 0, all but the first revisit it). A null page_id is never
    the first: such pages revisit the smallest page_id of their payload if there is one, else
    all are responses. Rows that repeat the smallest page_id of their payload are all responses.
    Other columns are ignored; an empty table gives an empty archive and result.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    register(spark)
    path = path or new_path(spark, "warc")
    archive_records(pages, min_revisit_bytes).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").schema(SCHEMA if columns is None else ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in columns)).load(path)
    return read


