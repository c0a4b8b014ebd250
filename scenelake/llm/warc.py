"""WARC archives as a PySpark Python data source, read and written.

Archives are gzip files with one member per record. Every member carries its
compressed length in the gzip extra field ``sl`` (as the WARC standard's annex
on gzip proposes), so a reader that has parsed the headers of an unwanted
record seeks to the next one without inflating the payload. Archives without
that field, and plain ``.warc`` files, are read too.

Planning: one input partition per file; the writer starts a new file every
``maxFileBytes``, so files stay small enough to be the unit of work. Predicates
on record_type, record_id, target_uri, refers_to, payload_digest and
payload_length are pushed into the reader and decided on the headers alone;
``payload=false`` skips every payload and reads no more of a block than its
HTTP header, which tells where the payload begins and so how long it is.

A record of type ``response`` holds an HTTP header and the payload, one of type
``revisit`` only the HTTP header, whose Content-Length is the payload's length,
and the record it repeats.

Headers keep URIs as they are, percent codes too; only line ends, which would
end the header, are written as ``%0D`` and ``%0A`` and read as such. Blanks
around a URI are not kept. Record names stand in angle brackets in the archive
and without them in the columns.

Defined cases: null names and URIs have no header and are read as null; a null
payload is an empty one; repeated rows are repeated records; a row without a
record type is a record without one; an empty table writes no file, and an
archive without files, or no folder, has no rows. Extra columns are ignored.
A payload is held whole, by one task at a time; unwanted ones are never inflated.

Writers put files into a staging folder; the driver moves them at commit, so a
repeated or failed task leaves nothing behind in the archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_length long, payload binary"
)
MAX_FILE_BYTES = 64 << 20
LEAST_REVISIT = 100  # bytes below which a repeated payload is stored again
DATE = "1970-01-01T00:00:00Z"  # archives of the same table are the same bytes
_VERSION = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
_READ = 1 << 16  # bytes read at a time of a wanted payload
_FIRST = 1 << 11  # bytes read at a time of headers
_STEP = 1 << 9  # bytes inflated at a time of headers


# --- records -------------------------------------------------------------------------------------------------------


def _one_line(value: str) -> str:
    """A header value as it is; line ends, which no URI may hold, become their percent codes."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _name(value: str) -> str:
    """A record's name without the brackets that archives put around it."""
    return value[1:-1] if value.startswith("<") and value.endswith(">") else value


def record_bytes(
    record_id: str | None, kind: str | None, uri: str | None, refers_to: str | None, digest: str, length: int, payload: bytes
) -> bytes:
    """One record as WARC bytes; a revisit leaves its payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    head = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind is not None:
        head.insert(0, ("WARC-Type", kind))
    for name, value, form in (
        ("WARC-Record-ID", record_id, "<{}>"),
        ("WARC-Target-URI", uri, "{}"),
        ("WARC-Refers-To", refers_to, "<{}>"),
    ):
        if value is not None:
            head.append((name, form.format(_one_line(value))))
    if kind == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + _END


def member(data: bytes) -> bytes:
    """A gzip member that tells its own compressed length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    sizes = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)  # 0: not told
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, *sizes)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Inflated:
    """Reads members of a gzip file one after another, and skips the rest of a member where its length is known.

    No more is inflated than was asked for, but for ``_STEP`` bytes at least at a time.
    """

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def open(self) -> bool:
        """Whether there is another member."""
        self.raw.seek(self.at)
        head = self.raw.read(24)
        if not head:
            return False
        self.length = 0
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            self.length = struct.unpack("<I", head[16:20])[0]
        self.raw.seek(self.at)
        self.box, self.out, self.taken = zlib.decompressobj(31), bytearray(), 0
        return True

    def need(self, n: int) -> None:
        """Inflate until ``n`` bytes are there or the member ends."""
        while len(self.out) < n and not self.box.eof:
            missing = n - len(self.out)
            got = self.box.unconsumed_tail
            if not got:
                got = self.raw.read(_READ if missing > _FIRST else _FIRST)
                self.taken += len(got)
            if not got:
                raise EOFError("a WARC member ends early")
            self.out += self.box.decompress(got, max(missing, _STEP))

    def head(self) -> bytes:
        """Up to and without the blank line after the headers."""
        while (end := self.out.find(_END)) < 0:
            before = len(self.out)
            self.need(before + 1)
            if len(self.out) == before:
                raise ValueError("a WARC record without an end of its headers")
        found = bytes(self.out[:end])
        del self.out[: end + len(_END)]
        return found

    def body(self, n: int) -> bytes:
        self.need(n)
        if len(self.out) < n:
            raise EOFError("a WARC record ends early")
        return bytes(self.out[:n])

    def close(self) -> None:
        """Go to the next member."""
        if self.length:
            self.at += self.length
            return
        while not self.box.eof:
            self.out.clear()
            self.need(_READ)
        self.at += self.taken - len(self.box.unused_data)


class _Stored:
    """Reads records of an uncompressed file; a skipped body is not read."""

    def __init__(self, raw):
        self.raw, self.at, self.size = raw, 0, raw.size()

    def open(self) -> bool:
        self.raw.seek(self.at)
        return self.at < self.size

    def head(self) -> bytes:
        out = bytearray()
        while (end := out.find(_END)) < 0:
            got = self.raw.read(4096)
            if not got:
                raise ValueError("a WARC record without an end of its headers")
            out += got
        self.start = self.at + end + len(_END)
        return bytes(out[:end])

    def body(self, n: int) -> bytes:
        self.raw.seek(self.start)
        return self.raw.read(n)

    def close(self) -> None:
        self.at = self.start + self.length + len(_END)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:])}


def _front(reader: _Inflated | _Stored, length: int) -> int:
    """Bytes of the HTTP header at the head of a block of ``length`` bytes, with the blank line after it."""
    got = 0
    while got < length:
        got = min(max(2 * got, 1024), length)
        if (end := reader.body(got).find(_END)) >= 0:
            return end + len(_END)
    return length


def read_file(raw, gzipped: bool, wanted, with_payload: bool = True) -> Iterator[tuple]:
    """Records of one file that pass ``wanted(values by column)``, in the order of ``SCHEMA``."""
    reader = _Inflated(raw) if gzipped else _Stored(raw)
    while reader.open():
        head = _headers(reader.head())
        length = int(head.get("content-length", 0))
        if not gzipped:
            reader.length = length
        named = lambda key: _name(head[key]) if key in head else None
        values = {
            "record_id": named("warc-record-id"),
            "record_type": head.get("warc-type"),
            "target_uri": head.get("warc-target-uri"),
            "refers_to": named("warc-refers-to"),
            "payload_digest": head.get("warc-payload-digest", "").partition(":")[2] or None,
        }
        if wanted(values):
            http = head.get("content-type", "").startswith("application/http")
            size, payload = None, None
            if with_payload or values["record_type"] == "revisit":
                block = reader.body(length)
                front, _, rest = block.partition(_END) if http else (b"", b"", block)
                told = [x for x in front.lower().split(b"\r\n") if x.startswith(b"content-length:")]
                payload = rest if values["record_type"] != "revisit" else None
                size = len(rest) if payload is not None else int(told[0].split(b":")[1]) if told else None
            else:
                # The payload is what the HTTP header leaves of the block, also where that tells no length or another.
                size = length - _front(reader, length) if http else length
            values["payload_length"] = size
            if wanted(values):
                yield (*values.values(), payload if with_payload else None)
        reader.close()


# --- data source ---------------------------------------------------------------------------------------------------


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    staged: list[str]


_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length")
_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x,
    EqualNullSafe: lambda v, x: v == x,
    In: lambda v, x: v is not None and v in x,
    GreaterThan: lambda v, x: v is not None and v > x,
    GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x,
    LessThanOrEqual: lambda v, x: v is not None and v <= x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    IsNotNull: lambda v, x: v is not None,
}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Keep what the headers decide; Spark does the rest."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        system, path = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted(x.path for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")))
        return [_File(x) for x in names] or [_File("")]

    def wanted(self, values: dict) -> bool:
        return all(_TESTS[kind](values[c], x) for c, kind, x in self.tests if c in values)

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as raw:
            yield from read_file(raw, partition.path.endswith(".gz"), self.wanted, self.with_payload)


class WarcWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.limit = int(options.get("maxfilebytes", options.get("maxFileBytes", MAX_FILE_BYTES)))
        self.run, self.overwrite = uuid.uuid4().hex, overwrite

    def write(self, iterator):
        system, path = _file_system(self.path)
        task = TaskContext.get()
        folder = f"{path}/_staged-{self.run}"
        system.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None or size > self.limit:
                    if out is not None:
                        out.close()
                    names.append(f"part-{task.partitionId():05d}-{len(names):04d}-{task.taskAttemptId()}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                payload = bytes(row.payload or b"")
                data = member(
                    record_bytes(
                        row.record_id,
                        row.record_type,
                        row.target_uri,
                        row.refers_to,
                        row.payload_digest or hashlib.sha256(payload).hexdigest(),
                        len(payload) if row.payload_length is None else row.payload_length,
                        payload,
                    )
                )
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        system, path = _file_system(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.is_file:
                    system.delete_file(old.path)
        for message in messages:
            for name in message.staged if message else []:
                system.move(f"{path}/_staged-{self.run}/{name}", f"{path}/{name}")
        self._clean(system, path)

    def abort(self, messages):
        self._clean(*_file_system(self.path))

    def _clean(self, system, path):
        staged = f"{path}/_staged-{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- pages ---------------------------------------------------------------------------------------------------------

_URN = "urn:page:"


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records of a pages table; of equal payloads of at least ``least`` bytes all but the first page revisit it.

    A null html is an empty payload. Rows that repeat the page_id of the first
    page are responses like it; a null page_id is never the first page.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    stamped = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")
    ).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    first = (
        stamped.where(F.col("length") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1 AND _first IS NOT NULL")
        .select(F.col("digest").alias("_digest"), "_first")
    )
    urn = lambda c: F.concat(F.lit(_URN), F.col(c).cast("string"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return stamped.join(first, F.col("digest") == F.col("_digest"), "left").select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn("_first")).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, folder: str) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all taken from the archives.

    The digest and length of a response are those of the payload as read.
    """
    register(spark)
    page = lambda c: F.substring(c, len(_URN) + 1, 20).cast("long")
    records = spark.read.format("warc").load(folder)
    return records.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha2("payload", 256))
        .otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
FROM f
"""
