"""WARC archives as a Python data source: written one gzip member a record, and read back.

*Writer.*  ``df.write.format("warc").mode("append").save(path)`` takes ``head string, block binary``.  Every
record is a gzip member of its own whose header names the member's length, so a reader can step over it
unread.  A task writes below ``_temporary``; the driver moves its files once all tasks have ended, so a task that
is run again leaves nothing double.  :func:`write_warc` writes a table of pages: equal payloads of at
least ``REVISIT_BYTES`` bytes are stored once; the record with the largest page_id is the response and the
others revisit it.  Only digests that repeat are joined, and payloads are shuffled only where these are
too many to broadcast (Spark checks their size).

*Reader.*  ``spark.read.format("warc")`` plans one partition per archive file of one path or several, plain or
gzipped (a member a record, or one for all), takes equality and ``IN`` predicates on record type, record id
and target URI, parses headers first, and skips the blocks of records that the predicates rule out or, with
``payload=false``, of all records: by seeking in plain files and in those of this writer, else by inflating without
decoding.  ``decode=true`` undoes chunked transfer and gzip or deflate content encoding.  A header that
cannot be parsed or lacks its length is skipped up to the next record's; with ``malformed=true`` each such
gap is a row of record type ``malformed`` with its length.  Files are opened with pyarrow's file systems
(local, HDFS, S3, GCS); a path without a scheme is on Hadoop's default one.  Archives are cut at about a gigabyte.

Null html is an empty payload.  Rows that tie for the largest page_id are each a response.  A null page_id
is written as ``null`` and read back as null; it is never the response of others unless all are null.
Record ids hold page_id and payload digest, so rows that share a page_id have ids of their own unless they are
equal.  Line breaks in a URL are written as spaces.  Extra columns are ignored.  An empty table gives an
archive folder without records.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from lodestone.plans.scratch import materialise, qualified

REVISIT_BYTES = 1000
#: Compressed bytes after which a task begins a new archive.
FILE_BYTES = 1 << 30
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())])
CHUNK, LONGEST_HEAD = 1 << 16, 1 << 20
#: A gzip header with an extra field: subfield ``Ln`` holds the length of the whole member in eight bytes.
_MAGIC, _GZIP = b"\x1f\x8b\x08", struct.Struct("<4sIBBH2sHQ")
_FLAGS = _MAGIC + b"\x04"


def records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, bytes, digest, refers_to`` (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    each = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"))
    shared = each.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # written, so that its size decides how it is joined, and so that the rows of one digest can be split
    joined = each.join(materialise(shared, "digests"), ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))).drop("first")


def _record() -> list[F.Column]:
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
    )
    return [head.alias("head"), block.cast("binary").alias("block")]


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page to new archive files below ``path``, each of about ``file_bytes``."""
    register(pages.sparkSession)
    records(pages).select(*_record()).write.format("warc").option("file_bytes", file_bytes).mode("append").save(qualified(pages.sparkSession, path))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; ``file:/x`` counts as local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """One gzip member that names its own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = _GZIP.size + len(body) + 8
    return _GZIP.pack(_FLAGS, 0, 0, 255, 12, b"Ln", 8, length) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes ``head, block`` rows; files appear below the path when the whole write succeeds."""

    def __init__(self, options):
        self.path, self.file_bytes = options["path"].rstrip("/"), int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        system, path = _open(self.path)
        names: list[str] = []
        out, held = None, 0
        for batch in iterator:
            for head, block in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                if out is None:
                    system.create_dir(f"{path}/_temporary", recursive=True)
                    names.append(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz")
                    out, held = system.open_output_stream(f"{path}/_temporary/{names[-1]}", compression=None), 0
                record = member(head.as_py() + END + block.as_py() + END)
                out.write(record)
                held += len(record)
                if held >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages):
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{path}/_temporary/{name}", f"{path}/{name}")

    def abort(self, messages):
        system, path = _open(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.delete_file(f"{path}/_temporary/{name}")


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Plain:
    """The bytes of an uncompressed archive, read in order."""

    def __init__(self, f):
        self.f, self.size, self.at, self.buf = f, f.size(), 0, b""

    def more(self) -> bytes:
        """The next bytes after the buffered ones; none at the end."""
        self.f.seek(self.at)
        data = self.f.read(CHUNK)
        self.at += len(data)
        return data

    def fill(self) -> bool:
        data = self.more()
        self.buf += data
        return bool(data)

    def take(self, n: int) -> bytes:
        parts, held = [self.buf], len(self.buf)
        while held < n and (data := self.more()):
            parts.append(data)
            held += len(data)
        whole = b"".join(parts)
        self.buf = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        self.at += max(0, n - len(self.buf))
        self.buf = self.buf[n:]


class _Gzip(_Plain):
    """The same of a gzipped archive."""

    def __init__(self, f):
        super().__init__(f)
        self.z, self.raw, self.start, self.end = None, b"", 0, None

    def more(self) -> bytes:
        while True:
            if self.z is None:
                if self.at >= self.size:
                    return b""
                self.raw = super().more()
                found = self.raw.find(_MAGIC)
                if found:  # bytes between members
                    self.at += (found if found > 0 else max(1, len(self.raw) - 2)) - len(self.raw)
                    continue
                self.start, self.end, self.z = self.at - len(self.raw), None, zlib.decompressobj(31)
                if self.raw.startswith(_FLAGS) and len(self.raw) >= _GZIP.size and (own := _GZIP.unpack_from(self.raw))[5] == b"Ln":
                    self.end = self.start + own[7]
            elif not self.raw and not (raw := super().more()):
                self.z = None
                return b""
            elif not self.raw:
                self.raw = raw
            try:
                out = self.z.decompress(self.raw, CHUNK)
            except zlib.error:
                self.z, self.at = None, self.start + 1
                continue
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z, self.raw = None, b""
            if out:
                return out

    def skip(self, n: int) -> None:
        if n <= len(self.buf):
            self.buf = self.buf[n:]
        elif self.z is not None and self.end is not None:  # a member of this writer holds one record
            self.at, self.z, self.raw, self.buf = self.end, None, b"", b""
        else:
            n -= len(self.buf)
            self.buf = b""
            while n > 0 and (data := self.more()):
                self.buf = data[n:]
                n -= len(data)


def _next_head(source: _Plain) -> tuple[bytes | None, int]:
    """The next record's headers (none at the end), and how many bytes that are none were passed over."""
    lost = 0
    while True:
        bare = source.buf.lstrip(b"\r\n")
        if not bare or len(bare) < 5:
            source.buf = bare
            if not source.fill():
                return None, lost + len(source.buf.strip(b"\r\n"))
            continue
        source.buf = bare
        if not bare.startswith(b"WARC/"):
            found = bare.find(b"\nWARC/")
            if found < 0:
                keep = 5
                lost += len(bare) - keep
                source.buf = bare[-keep:]
                if not source.fill():
                    return None, lost + keep
                continue
            lost += found
            source.buf = bare[found + 1 :]
            continue
        end = bare.find(END)
        if end >= 0:
            source.buf = bare[end + 4 :]
            return bare[:end], lost
        if len(bare) > LONGEST_HEAD or not source.fill():
            lost += 5
            source.buf = source.buf[5:]


def _dechunked(data: bytes) -> bytes:
    """A chunked body put together; unchanged from where it is not well formed."""
    out, at = [], 0
    while (line := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) + data[at:]
        if n == 0:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + n])
        at = line + 2 + n + 2
    return b"".join(out) + data[at:]


def _decoded(payload: bytes, http: dict[str, str]) -> bytes:
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload = _dechunked(payload)
    coding = http.get("content-encoding", "").lower()
    for wbits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            return zlib.decompressobj(wbits).decompress(payload)
        except zlib.error:
            continue
    return payload


class WarcReader(DataSourceReader):
    """Plans files; holds the predicates that were pushed down."""

    COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri"}

    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        on = lambda name, default: options.get(name, default).lower() == "true"
        self.payload, self.decode, self.malformed = on("payload", "true"), on("decode", "false"), on("malformed", "false")
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in self.COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        out = []
        for whole in self.paths:
            system, path = _open(whole)
            folder = system.get_file_info(path).type == pafs.FileType.Directory
            found = system.get_file_info(pafs.FileSelector(path, recursive=True)) if folder else [system.get_file_info(path)]
            prefix = whole.split("://")[0] + "://" if "://" in whole and not whole.startswith("file:") else ""
            hidden = lambda p, path=path: any(x[:1] in ("_", ".") for x in p[len(path) :].split("/"))
            out += [_File(prefix + f.path) for f in found if f.type == pafs.FileType.File and f.size and not (folder and hidden(f.path))]
        return out

    def read(self, partition):
        if partition is None:  # no files
            return
        system, path = _open(partition.path)
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(path) as f:
            source = (_Gzip if f.read(3) == _MAGIC else _Plain)(f)
            while True:
                head, lost = _next_head(source)
                if lost and self.malformed:
                    rows.append(("malformed", None, None, None, None, lost, None))
                if head is None:
                    break
                headers = _headers(head)
                length = headers.get("content-length", "")
                if not length.isdecimal():
                    if self.malformed:
                        rows.append(("malformed", None, None, None, None, len(head), None))
                    continue
                row = self._row(source, headers, int(length))
                if row is None:
                    continue
                rows.append(row)
                held += len(row[6] or b"")
                if len(rows) >= 1000 or held > 8_000_000:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, source: _Plain, headers: dict[str, str], length: int) -> tuple | None:
        record_id = headers.get("warc-record-id", "").strip("<>") or None
        refers = headers.get("warc-refers-to", "").strip("<>") or None
        fixed = (headers.get("warc-type"), record_id, headers.get("warc-target-uri"))
        if any(name in self.wanted and value not in self.wanted[name] for name, value in zip(self.COLUMNS, fixed, strict=True)):
            source.skip(length)
            return None
        http_length, payload = None, None
        if headers.get("content-type", "").startswith("application/http"):
            whole = self.payload and fixed[0] != "revisit"
            data = source.take(length if whole else min(length, 4096))
            source.skip(length - len(data))
            end = data.find(END)
            if end >= 0:
                http = _headers(data[:end])
                stated = http.get("content-length", "")
                http_length = int(stated) if stated.isdecimal() else length - end - 4
                payload = data[end + 4 :] if whole else None
                if whole and self.decode:
                    payload = _decoded(payload, http)
        elif self.payload:
            payload = source.take(length)
        else:
            source.skip(length)
        return (*fixed, refers, headers.get("warc-payload-digest"), http_length, payload)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``, ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str | list[str], payload: bool = True, decode: bool = False) -> DataFrame:
    """The records of the archives below a path or several."""
    register(spark)
    path = qualified(spark, path) if isinstance(path, str) else [qualified(spark, p) for p in path]
    return spark.read.format("warc").option("payload", str(payload).lower()).option("decode", str(decode).lower()).load(path)


def page_table(archive: DataFrame) -> DataFrame:
    """Archive records as pages: sizes and digests of responses are taken from their payloads, of revisits from their headers."""
    page = lambda c: F.expr(f"try_cast(substring_index(substring({c}, {len(URN) + 1}), ':', 1) AS bigint)")
    revisit = F.col("record_type") == "revisit"
    return archive.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.substring_index("payload_digest", ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
