"""Media columns: payloads as grey-scale images in archives, read back by a byte-range data source.

A payload is a text's UTF-8 bytes and zeros up to a positive multiple of 64.  Its stored form is a PNG of 8-bit samples,
64 a row, with the unpadded length in a text chunk, so equal payloads have equal files.  Images are members of
uncompressed ZIP archives of about `ARCHIVE_BYTES`.

Reading plans partitions of `RANGE_BYTES` over the archives from their sizes alone, so the planner never holds a
directory.  A partition's task reads the archive's directory, takes the members that start in its range, streams them in
runs of neighbours through Arrow, and checks each member's CRC.  A member that comes short or damaged is read again by
its offset, alone, up to `attempts` times; the others of its run are unaffected.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import named_files, shared_dir, small_batches, stored

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
_RUN = 4 << 20
SCHEMA = "archive string, member string, position long, doc_id long, n_bytes long, media binary, payload binary, feature string"
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL, _ENTRY, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes, level: int = 4) -> bytes:
    """The stored form of a payload's unpadded bytes."""
    samples = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = samples
    header = struct.pack(">2I5B", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"Bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, length = 8, [], 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IDAT":
            packed.append(body)
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            length = int(body[6:])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter other than 0")
    return rows[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy in bits of the samples, and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256) / len(x)
    some = n[n > 0]
    values = np.arange(256)
    mean = float(n @ values)
    deviation = float(np.sqrt(max(0.0, n @ (values - mean) ** 2)))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};step={step:.4f}"


class ArchiveWriter:
    """One uncompressed ZIP archive, written front to back."""

    def __init__(self, out):
        self.out, self.entries, self.at = out, [], 0

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        self.entries.append(_ENTRY.pack(b"PK\1\2", 20, 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0, 0, 0, 0, 0, self.at) + raw)
        self.out.write(_LOCAL.pack(b"PK\3\4", 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0) + raw)
        self.out.write(data)
        self.at += _LOCAL.size + len(raw) + len(data)

    def close(self) -> None:
        directory = b"".join(self.entries)
        n = len(self.entries)
        self.out.write(directory + _END.pack(b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), len(directory), self.at, 0))
        self.out.close()


def directory(file, size: int) -> list[tuple[int, int, int, str]]:
    """(offset, bytes of data, CRC, name) of all members, from the directory at the end."""
    file.seek(size - _END.size)
    end = _END.unpack(file.read(_END.size))
    if end[0] != b"PK\5\6":
        raise ValueError("no archive directory")
    file.seek(end[6])
    data, at, found = file.read(end[5]), 0, []
    while at < len(data):
        e = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        found.append((e[16], e[8], e[7], data[at : at + e[10]].decode()))
        at += e[10] + e[11] + e[12]
    return sorted(found)


def _member(data: bytes, crc: int, size: int) -> bytes:
    if len(data) < _LOCAL.size or data[:4] != b"PK\3\4":
        raise ValueError("no member here")
    head = _LOCAL.unpack_from(data)
    start = _LOCAL.size + head[9] + head[10]
    body = data[start : start + size]
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("damaged member")
    return body


def members(opened, path: str, start: int, end: int, attempts: int = 3) -> Iterator[tuple[str, int, bytes]]:
    """(name, offset, data) of the members of an archive that start in start..end.  opened(path) gives (file, size)."""
    file, size = opened(path)
    with file:
        mine = [m for m in directory(file, size) if start <= m[0] < end]
        k = 0
        while k < len(mine):
            first, j = mine[k][0], k
            span = lambda m: m[0] + _LOCAL.size + len(m[3].encode()) + m[1]
            while j < len(mine) and (j == k or span(mine[j]) - first <= _RUN):
                j += 1
            try:
                file.seek(first)
                run = file.read(span(mine[j - 1]) - first)
            except OSError:
                run = b""
            for m in mine[k:j]:
                try:
                    data = _member(run[m[0] - first : span(m) - first], m[2], m[1])
                except ValueError:
                    data = _again(opened, path, m, span(m), attempts)
                yield m[3], m[0], data
            k = j


def _again(opened, path: str, m: tuple[int, int, int, str], end: int, attempts: int) -> bytes:
    for left in reversed(range(attempts)):
        try:
            file, _ = opened(path)
            with file:
                file.seek(m[0])
                return _member(file.read(end - m[0]), m[2], m[1])
        except (OSError, ValueError):
            if not left:
                raise


class RangePartition(InputPartition):
    pass


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def partitions(self):
        store, _ = self._store()
        found = [(f.path, f.size) for f in store.get_file_info(named_files(self.uri, self.manifest, "archive", (".zip",)))]
        ranges = [(p, s, min(s + self.range_bytes, size)) for p, size in found for s in range(0, size, self.range_bytes)]
        return [RangePartition(r) for r in ranges] or [RangePartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        path, start, end = partition.value
        store, _ = self._store()

        def opened(p: str):
            file = store.open_input_file(p)
            return file, file.size()

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]
        rows, held = [], 0
        for name, at, media in members(opened, path, start, end, self.attempts):
            payload, n = from_png(media)
            key = name.rpartition("/")[2].removesuffix(".png")
            rows.append((path, name, at, None if key == "null" else int(key), n, media, payload, feature(payload)))
            held += len(media) + len(payload) + 200
            if held > _RUN:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class ArchiveSource(DataSource):
    """format("media_archive"): options path (folder URI), manifest (URI of a table of archives), rangeBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def write(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores the text of each row of docs (doc_id, text) as a member; returns archive, n.  A null text is an empty one.

    Repeated rows are members of their own.  Each attempt at a task writes archives of its own name; only those in the
    result count.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, n = None, "", 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                if out is None:
                    name, n = f"{base}/{uuid.uuid4().hex}.zip", 0
                    out = ArchiveWriter(store.open_output_stream(name, compression=None))
                key = doc_id.as_py()
                out.add(f"{n:06d}/{'null' if key is None else key}.png", to_png((text.as_py() or "").encode("utf-8", "surrogatepass")))
                n += 1
                if out.at > archive_bytes or n == 0xFFFF:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "n"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "archive string, n long")


def read(spark: SparkSession, path: str, manifest: str | None = None) -> DataFrame:
    """Members of all archives under a path, or of those that a manifest table names."""
    spark.dataSource.register(ArchiveSource)
    source = spark.read.format("media_archive").option("path", path)
    return (source.option("manifest", manifest) if manifest else source).load()


def stored_media(docs: DataFrame) -> DataFrame:
    """Writes docs to new archives in the shared folder and reads them back: SCHEMA for every row of docs.

    The archives of attempts that succeeded are named by a manifest table beside them; those of others are never read.
    """
    small_batches(docs.sparkSession)
    path = shared_dir(docs.sparkSession)
    stored(write(docs, f"{path}/media"), "manifest", path)
    return read(docs.sparkSession, f"{path}/media", f"{path}/manifest")
