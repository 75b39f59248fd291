"""Spreadsheets as a Python data source: format("xlsx_grid") gives file, sheet, r, c, value, and merged ranges by option."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched
from xml.etree import ElementTree as E

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CELL, _VALUE, _TEXT = f"{_M}c", f"{_M}v", f"{_M}t"
_REF = re.compile(r"([A-Z]+)(\d+)").match


@lru_cache(1 << 10)
def _column(letters: str) -> int:
    c = 0
    for x in letters:
        c = 26 * c + ord(x) - 64
    return c - 1


def _place(ref: str) -> tuple[int, int]:
    letters, digits = _REF(ref).groups()
    return int(digits) - 1, _column(letters)


def _text(c: E.Element, shared: list[str]) -> str | None:
    """The text of a cell."""
    kind = c.get("t")
    if kind == "inlineStr":
        held = c[0] if len(c) == 1 else None
        if held is not None and len(held) == 1 and held[0].tag == _TEXT:  # <is><t>, as nearly all are
            return held[0].text
        return "".join(t.text or "" for t in c.iter(_TEXT))
    v = c[0] if len(c) == 1 and c[0].tag == _VALUE else c.find(_VALUE)
    return None if v is None else shared[int(v.text)] if kind == "s" else v.text


def first_xlsx(data: bytes) -> bytes:  # O-11: the workbook itself, or the first of a zip of workbooks
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if "xl/workbook.xml" in names:
            return data
        return z.read(next(n for n in names if n.lower().endswith(".xlsx")))


def cells(data: bytes, merged: bool = False) -> Iterator[tuple]:
    """(sheet, r, c, value) of all cells with text, or (sheet, r0, c0, r1, c1) of merged ranges, counted from 0."""
    with zipfile.ZipFile(io.BytesIO(first_xlsx(data))) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in E.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in E.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            root, name = E.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")), sheet.get("name")
            if merged:
                for m in root.iter(f"{_M}mergeCell"):
                    a, _, b = m.get("ref").partition(":")
                    yield (name, *_place(a), *_place(b or a))
                continue
            for c in root.iter(_CELL):
                if text := _text(c, shared):
                    yield (name, *_place(c.get("r")), text)


class FilePartition(InputPartition):
    """Paths of files that one task reads."""


#: Bytes and number of files up to which they share a task.
PACK_BYTES, PACK_FILES = 8 << 20, 64
#: Rows of a batch that a task hands to Spark.
BATCH_ROWS = 10_000
_TYPES = {"string": pa.string(), "int": pa.int32()}


def packed(files: list[tuple[str, int]]) -> list[FilePartition]:
    """Files (path, size) in packs for one task each."""
    packs: list[list[str]] = []
    held = 0
    for path, size in sorted(files):
        if not packs or held + size > PACK_BYTES or len(packs[-1]) >= PACK_FILES:
            packs.append([])
            held = 0
        packs[-1].append(path)
        held += size
    return [FilePartition(p) for p in packs]


class GridReader(DataSourceReader):
    def __init__(self, options, columns: str):
        self.columns = [tuple(c.split()) for c in columns.split(", ")]
        self.uri, self.merged = options["path"], options.get("merged", "false") == "true"

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(path).type == fs.FileType.File:
            return [FilePartition([path])]
        return packed([(f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.lower().endswith((".xlsx", ".zip"))])

    def read(self, partition):
        names = [name for name, _ in self.columns]
        for rows in batched(self._rows(partition), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(values, _TYPES[kind]) for values, (_, kind) in zip(zip(*rows), self.columns)], names)

    def _rows(self, partition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        for path in partition.value if partition else ():  # without files there is one partition, of None
            with store.open_input_file(path) as f:
                data = f.read()
            for row in cells(data, self.merged):
                yield (path, *row)


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_grid"

    def schema(self) -> str:
        if self.options.get("merged", "false") == "true":
            return "file string, sheet string, r0 int, c0 int, r1 int, c1 int"
        return "file string, sheet string, r int, c int, value string"

    def reader(self, schema):
        return GridReader(self.options, self.schema())


def read_grid(spark: SparkSession, uri: str, merged: bool = False) -> DataFrame:
    spark.dataSource.register(GridSource)
    return spark.read.format("xlsx_grid").option("path", uri).option("merged", str(merged).lower()).load()
