"""WARC archives as a PySpark Python data source, and a writer for pages.

Reading plans one partition a file.  Filters on `record_type` and on the header columns are pushed down: a record's
header is parsed first, and when it fails a filter the block is skipped without decoding it: in an uncompressed file by
seeking, and in a file of gzip members whose headers carry the skip lengths of the format's annex (field SL), by seeking
to the next member, with a few KB inflated at most.  In other gzip files the bytes are dropped as they are inflated.
Filters that the source can't take stay with Spark.  With option payload=false no payload is returned, but digests and
lengths still are.  A record without a SHA-1 digest in its header is filtered by the digest of its payload.

Files come from the shared folder through pyarrow's file systems, so a path may be a URI.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

from .common import bitmap, in_bitmap, named_files, shared_dir, small_batches, stored, without

SCHEMA = "record_type string, record_id string, target_uri string, date string, page_id long, refers_to long, payload_digest string, payload_bytes long, content_length long, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}
FILE_BYTES = 64 << 20
_PIECE, _RAW, _FIRST = 1 << 20, 1 << 14, 1 << 12
_ID = "<urn:x-page:{}>"


def opened(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Inflated:
    """The bytes of a file of gzip members, or of a plain file, with read, line and skip."""

    def __init__(self, file, packed: bool):
        self.file, self.packed = io.BufferedReader(file, _PIECE), packed
        self.held, self.at, self.member = b"", 0, None
        #: Of the current member: where it starts, its packed and plain bytes if it says so, and the bytes inflated.
        self.start, self.lengths, self.made = 0, None, 0

    def _more(self) -> bool:
        if not self.packed:
            data = self.file.read(_PIECE)
        else:
            data = b""
            while not data:
                if self.member is None or self.member.eof:
                    if self.member is not None:
                        self.file.seek(-len(self.member.unused_data), 1)
                    self.start, raw = self.file.tell(), self.file.read(_RAW)
                    if not raw:
                        self.member = None
                        return False
                    self.lengths, self.made, self.member = _skip_lengths(raw), 0, zlib.decompressobj(31)
                    data = self.member.decompress(raw, _FIRST)
                else:
                    raw = self.member.unconsumed_tail or self.file.read(_RAW)
                    if not raw:
                        raise EOFError("archive ends within a record")
                    data = self.member.decompress(raw, _PIECE)
            self.made += len(data)
        self.held, self.at = self.held[self.at :] + data, 0
        return bool(data)

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                return None
        found, self.at = self.held[self.at : end + 1], end + 1
        return found

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.held) and not self._more():
                raise EOFError("archive ends within a record")
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        have = len(self.held) - self.at
        if n > have and not self.packed:
            self.file.seek(n - have, 1)
            self.held, self.at = b"", 0
            return
        if n > have and self.lengths and self.made - have + n + 4 >= self.lengths[1]:  # what is skipped ends the member
            self.file.seek(self.start + self.lengths[0])
            self.held, self.at, self.member = b"", 0, None
            return
        while n:
            if self.at == len(self.held) and not self._more():
                raise EOFError("archive ends within a record")
            part = min(n, len(self.held) - self.at)
            self.at += part
            n -= part


def _skip_lengths(raw: bytes) -> tuple[int, int] | None:
    """Packed and plain bytes of a gzip member, from field SL of its header."""
    if len(raw) < 12 or not raw[3] & 4:
        return None
    end, at = 12 + int.from_bytes(raw[10:12], "little"), 12
    while at + 4 <= end <= len(raw):
        size = int.from_bytes(raw[at + 2 : at + 4], "little")
        if raw[at : at + 2] == b"SL" and size == 8:
            return struct.unpack_from("<2I", raw, at + 4)
        at += 4 + size
    return None


def _number(text: str | None, before: str = "", after: str = "") -> int | None:
    text = (text or "").removeprefix(before).removesuffix(after)
    return int(text) if text.lstrip("-").isdigit() else None


def records(file, packed: bool, wanted: dict[str, set], payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA whose header columns are in wanted."""
    source = _Inflated(file, packed)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := source.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head["content-length"])
        got = {c: head.get(h) for c, h in HEADERS.items()}
        kind, _, digest = (got["payload_digest"] or "").rpartition(":")
        got["payload_digest"] = digest if digest and kind.lower() in ("", "sha1") else None
        late = got["payload_digest"] is None and got["record_type"] in ("response", "resource")
        if any(got[c] not in values for c, values in wanted.items() if not (late and c == "payload_digest")):
            source.skip(length)
            continue
        size, body = _number(head.get("x-payload-length")), None
        if got["record_type"] in ("response", "resource"):
            block = source.read(length)
            body = block.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else block
            if got["payload_digest"] not in (None, digest := sha1_base32(body)):
                raise ValueError(f"payload of {got['record_id']} has digest {digest}, not {got['payload_digest']}")
            got["payload_digest"], size = digest, len(body)
            if late and digest not in wanted.get("payload_digest", {digest}):
                continue
        else:
            source.skip(length)
        yield (*(got[c] for c in ("record_type", "record_id", "target_uri", "date")), _number(got["record_id"], "<urn:x-page:", ">"), _number(head.get("warc-refers-to"), "<urn:x-page:", ">"), got["payload_digest"], size, length, body if payload else None)


class FilePartition(InputPartition):
    pass


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.manifest = options["path"], options.get("manifest")
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, In, EqualNullSafe)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                values -= set() if isinstance(f, EqualNullSafe) else {None}
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (name in HEADERS and isinstance(f, IsNotNull) and name in self.wanted):
                yield f

    def partitions(self):
        found = named_files(self.path, self.manifest, "file", (".warc", ".warc.gz"))
        return [FilePartition((self.path, f)) for f in found] or [FilePartition((self.path, None))]

    def read(self, partition):
        uri, path = partition.value
        if path is None:
            return
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64() if " long" in f else pa.binary() if " binary" in f else pa.string() for f in SCHEMA.split(", ")]
        store, _ = opened(uri)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        with store.open_input_file(path) as file:
            rows, held = [], 0
            for r in records(file, path.endswith(".gz"), self.wanted, self.payload):
                rows.append(r)
                held += len(r[-1] or b"") + 200
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


class WarcSource(DataSource):
    """format("warc"): options path (file or folder URI), manifest (URI of a table of files), payload (true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True, manifest: str | None = None) -> DataFrame:
    """Records of all archives under a path, or of those that a manifest table names.  Filters reach the source (spark.sql.python.filterPushdown.enabled is set)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    source = spark.read.format("warc").option("path", path).option("payload", str(payload).lower())
    return (source.option("manifest", manifest) if manifest else source).load()


def _record(kind: str, page_id, url, digest: str, html: bytes, refers_to, size: int) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_ID.format('null' if page_id is None else page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if kind == "revisit" else http + html
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_ID.format(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "".join(f"{x}\r\n" for x in ["WARC/1.1", *head, ""]).encode() + block + b"\r\n\r\n"


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, size, sha1 (hex), head: pages with, for payloads of at least `least` bytes that occur more than once, the largest page_id of equal payloads.

    Digests and ids are shuffled, and of the texts only those of repeated payloads: a bitmap of fixed size tells which
    pages have one.  The heads are a stored table, so Spark may split the join where one payload holds many pages.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html).alias("sha1"))
    heads = known.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = stored(heads, "heads")
    hit = in_bitmap(pages.sparkSession, bitmap(heads.select(F.xxhash64("sha1").alias("h"))))(F.xxhash64("sha1"))
    return known.where(hit).join(heads, "sha1", "left").unionByName(known.where(~hit).withColumn("head", F.lit(None).cast("long")))


def write(pages: DataFrame, path: str, *, least: int = 0, packed: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives under path; returns file, n.

    A null html is an empty payload.  Rows that share the largest page_id of a payload are all responses, and so is a
    page without id when no page of its payload has one.  Each attempt at a task writes files of its own name; only those
    in the result count.
    """

    def run(batches):
        store, base = opened(path)
        store.create_dir(base, recursive=True)
        out, name, n = None, "", 0
        for b in batches:
            for page_id, url, html, size, sha1, head in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "sha1", "head"))):
                if out is None:
                    name, n = f"{base}/{uuid.uuid4().hex}.warc{'.gz' if packed else ''}", 0
                    out = store.open_output_stream(name, compression=None)
                    info = b"software: factloom\r\n"
                    first = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(info), info)
                    out.write(_gzip(first) if packed else first)
                kind = "revisit" if head is not None and head != page_id else "response"
                record = _record(kind, page_id, url, base64.b32encode(bytes.fromhex(sha1)).decode(), html, head, size)
                out.write(_gzip(record) if packed else record)
                n += 1
                if out.tell() > file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "n"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "n"])

    known = without(deduplicated(pages, least), "file", "n")
    return known.mapInArrow(run, "file string, n long")


def _gzip(data: bytes) -> bytes:
    """A gzip member with its skip lengths in field SL, where they fit."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    tail = struct.pack("<2I", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\4\0\0\0\0\0\xff" + struct.pack("<H2sH2I", 12, b"SL", 8, size, len(data)) + body + tail


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to a new folder and reads the records back.

    The files of attempts that succeeded are named by a manifest table beside them; those of others are never read.  An
    empty table gives an empty archive and no records.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = shared_dir(spark)
    stored(write(pages, f"{path}/warc", **options), "manifest", path)
    return read(spark, f"{path}/warc", payload=False, manifest=f"{path}/manifest")
