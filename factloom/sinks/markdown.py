"""Document sets as files: rows of folder, path and content become root/folder/path, written by the tasks that hold them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .reports import ReportWriter, Written, each_row


class DocumentWriter(ReportWriter):
    def __init__(self, uri: str):
        self.uri, self.pending = uri.rstrip("/"), f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = self._store()
        at, done = f"{root}/{self.pending}/{uuid.uuid4().hex}", []
        store.create_dir(at, recursive=True)
        for number, (folder, path, content) in enumerate(each_row(rows)):
            with store.open_output_stream(f"{at}/{number}") as out:
                out.write(bytes(content or b""))
            done.append((f"{at}/{number}", f"{folder}/{path}"))
        return self._noted(store, at, done)

    def commit(self, messages: list) -> None:
        store, root = self._store()
        self._move(store, root, messages)
        self._clean()


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_documents(docs: DataFrame, uri: str) -> None:
    """Writes docs (folder, path, content as text or bytes) below uri; a file that is there is replaced, others stay.  Of rows of one path any one counts."""
    docs.sparkSession.dataSource.register(DocumentSink)
    docs.select("folder", "path", F.col("content").cast("binary").alias("content")).write.format("document_files").option("path", uri).mode("append").save()
