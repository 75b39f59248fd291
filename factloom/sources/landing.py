"""Files behind links, fetched by tasks into a landing folder: format("landing") over a table of links.

A partition is a few links.  Each link is fetched on its own, several times if it fails in a way that may pass, and gives
one row that says where its file is or why it isn't there; one bad link spoils nothing.  A file that has landed before is
not fetched again, so a task that runs twice, or a job that is run again, fetches what is missing.
"""

from __future__ import annotations

import hashlib
import re
import ssl
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .staged import shared_dir

SCHEMA = "url string, path string, n_bytes long, attempts int, error string"
#: Links of a partition.
LINKS = 16
#: Answers after which another attempt may do better.
PASSING = {408, 425, 429, 500, 502, 503, 504}


def landed_name(url: str) -> str:
    """A file's name in the landing folder: the decoded last part of its path, after a digest of the whole URL."""
    last = re.sub(r"[^\w.()-]", "_", unquote(urlsplit(url).path.rstrip("/").rpartition("/")[2]))[-80:]
    return f"{hashlib.sha256(url.encode()).hexdigest()[:16]}-{last}"


class Links(InputPartition):
    """URLs that one task fetches."""


class LandingReader(DataSourceReader):
    def __init__(self, options):
        self.links, self.uri = options["links"], options["path"].rstrip("/")
        self.attempts, self.timeout, self.pause = int(options.get("attempts", 3)), float(options.get("timeout", 60)), float(options.get("pause", 1))

    def partitions(self) -> list[Links]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.links)
        urls = ds.dataset(at, filesystem=store, format="parquet").to_table(columns=["url"])["url"].to_pylist()
        return [Links(urls[i : i + LINKS]) for i in range(0, len(urls), LINKS)]

    def _get(self, url: str) -> tuple[bytes, int]:
        for attempt in range(1, self.attempts + 1):
            try:
                request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
                with urllib.request.urlopen(request, timeout=self.timeout, context=ssl.create_default_context()) as r:
                    return r.read(), attempt
            except (OSError, urllib.error.URLError) as e:
                if attempt == self.attempts or isinstance(e, urllib.error.HTTPError) and e.code not in PASSING:
                    e.attempts = attempt
                    raise
                time.sleep(self.pause * 2 ** (attempt - 1))
        raise ValueError("no attempt is allowed")

    def read(self, partition: Links) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        for url in partition.value if partition else ():  # without links there is one partition, of None
            path = f"{root}/{landed_name(url)}"
            there = store.get_file_info(path)
            if there.type == fs.FileType.File:
                yield url, path, there.size, 0, None
                continue
            try:
                data, attempts = self._get(url)
            except Exception as e:  # whatever a link's server does is that link's error
                yield url, None, None, getattr(e, "attempts", 1), f"{type(e).__name__}: {e}"
                continue
            part = f"{root}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(data)
            store.move(part, path)
            yield url, path, len(data), attempts, None


class LandingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandingReader:
        return LandingReader(self.options)


def fetched(links: DataFrame, uri: str, attempts: int = 3, timeout: float = 60.0, pause: float = 1.0) -> DataFrame:  # O-09, O-11
    """SCHEMA rows, one for each distinct url of links, whose files are in uri once the rows have been read; attempts is 0 for one that was there."""
    spark = links.sparkSession
    spark.dataSource.register(LandingSource)
    manifest = f"{shared_dir(spark)}/links"
    links.select("url").where(F.col("url").isNotNull()).distinct().write.parquet(manifest)
    reader = spark.read.format("landing").option("links", manifest).option("path", uri)
    return reader.option("attempts", attempts).option("timeout", timeout).option("pause", pause).load()
