"""Facts of folders kept as state, so that a changed file costs its own parsing and nothing else.

parse_changed() compares the files below a root with what was read of them before, and parses those that are new or
differ in time or size, and only these, into facts in a landing folder: for each file the first valued fact of each code,
and a row that says that the file was read, or is gone.  (A file stream of Spark's takes a path once, so it would miss
changes.)  fold() is a stream over the landing folder, which keeps the facts of each file of a folder as keyed state.
What a file said before goes when it comes again, and each folder that a batch touches puts out the first fact of each
code by the order of its files, as find_codes() gives it for the folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import lookup
from ..operators import tables as X
from ..sources.documents import literal_glob
from ..sources.staged import staged
from . import ingest

#: A fact of a file; code is null in the row that says that the file was read, with its time and length, null for one that is gone.
LANDED = "folder string, path string, version long, stamp timestamp, length long, code string, entry_ord long, label string, value double"
FOUND = "folder string, code string, label string, value double, file_name string"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _listed(spark: SparkSession, root: str, *paths: str) -> DataFrame:
    """folder, path, content, stamp, length of the files below root's folders, or of some of them; contents are read only where they are used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load([literal_glob(p) for p in paths or (root,)])
    return ingest.keyed(raw, root, F.col("modificationTime").alias("stamp"), "length")


def file_facts(files: DataFrame, version: int, period: int = 1) -> DataFrame:
    """LANDED rows of files (folder, path, content, stamp, length)."""
    # each file is a document of its own here, so the order of a folder's files doesn't matter yet
    docs = files.select(F.to_json(F.struct("folder", "path")).alias("folder"), F.lit(1).alias("file_ord"), F.col("path").alias("file_name"), "content")
    facts = lookup.code_facts(X.code_entries(X.row_lines(X.doc_lines(docs))), period).where("value IS NOT NULL")
    first = facts.groupBy("folder", "code").agg(F.min_by(F.struct("entry_ord", "label", "value"), "entry_ord").alias("f"))
    said = first.select(F.from_json("folder", "folder string, path string").alias("k"), "code", "f.*").select("k.folder", "k.path", "code", F.col("entry_ord").cast("long").alias("entry_ord"), "label", "value")
    return _landed(files.select("folder", "path", "stamp", "length").unionByName(said, allowMissingColumns=True), version)


def _landed(rows: DataFrame, version: int) -> DataFrame:
    typed = [F.col(n).cast(t).alias(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in LANDED.split(", ")) if n != "version"]
    return rows.select(*typed, F.lit(version).cast("long").alias("version"))


def parse_changed(spark: SparkSession, root: str, landing: str, period: int = 1, most_files: int = 10_000) -> int:
    """Parses new and changed files of root/<folder>/** into landing/batch=<number>; the number of files parsed.

    Where a quarter of all files changed or more, the root's files are read in one pass that keeps the changed ones,
    whose names stay in tasks then; fewer are read by their paths, at most `most_files` at a time.  The root isn't
    listed anew for each of these.  A batch that failed leaves nothing and its files are found again.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(landing)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
    marks = spark.read.schema(LANDED).option("recursiveFileLookup", "true").parquet(literal_glob(landing)).where("code IS NULL")
    known = staged(marks.groupBy("folder", "path").agg(F.max_by(F.struct("stamp", "length"), "version").alias("was"), F.max("version").alias("version")), "known")
    now = staged(_listed(spark, root).select("folder", "path", "stamp", "length"), "now")
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    differs = ~F.coalesce((F.col("was.stamp") == F.col("stamp")) & (F.col("was.length") == F.col("length")), F.lit(False))
    changed = staged(now.join(known, ["folder", "path"], "left").where(differs).select("folder", "path"), "changed")
    gone = _landed(staged(known.where("was.stamp IS NOT NULL").join(now, ["folder", "path"], "left_anti").select("folder", "path"), "gone"), version)
    parsed = changed.count()
    if parsed and 4 * parsed >= now.count():
        rounds = [_listed(spark, root).join(changed, ["folder", "path"], "left_semi")]
    else:
        paths = [f"{root.rstrip('/')}/{r.folder}/{r.path}" for r in changed.toLocalIterator()]
        rounds = [_listed(spark, root, *paths[k : k + most_files]) for k in range(0, parsed, most_files)]
    for number, some in enumerate(rounds):
        rows = file_facts(some, version + number, period)
        (rows if number else gone.unionByName(rows)).write.mode("overwrite").parquet(f"{landing}/batch={version + number}")
    if not rounds and not gone.isEmpty():
        gone.write.mode("overwrite").parquet(f"{landing}/batch={version}")
    return parsed


class FolderFacts(StatefulProcessor):
    """State of a folder: (path, code) to its fact, and path to the version of the file that was read last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getMapState("facts", "path string, code string", "entry_ord long, label string, value double")
        self.files = handle.getMapState("files", "path string", "version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple[int, dict]] = {}
        for part in rows:
            for path, version, code, entry_ord, label, value in part[["path", "version", "code", "entry_ord", "label", "value"]].itertuples(index=False):
                seen, said = newest.get(path, (-1, {}))
                if version > seen:
                    seen, said = version, {}
                if version == seen and isinstance(code, str):
                    said[code] = (int(entry_ord), label, float(value))
                newest[path] = (seen, said)
        newest = {p: x for p, x in newest.items() if not self.files.containsKey((p,)) or self.files.getValue((p,))[0] <= x[0]}
        for path, code in [k for k in self.facts.keys() if k[0] in newest]:
            self.facts.removeKey((path, code))
        for path, (version, said) in newest.items():
            self.files.updateValue((path,), (version,))
            for code, fact in said.items():
                self.facts.updateValue((path, code), fact)
        best: dict[str, tuple] = {}
        for (path, code), (entry_ord, label, value) in self.facts.iterator():
            place = (path.split("/"), entry_ord)
            if code not in best or place < best[code][0]:
                best[code] = (place, label, value, path.rpartition("/")[2])
        # a folder without facts has one row without code, so that its rows of before go
        out = [(key[0], code, label, value, name) for code, (_, label, value, name) in best.items()] or [(key[0], None, None, None, None)]
        yield pd.DataFrame(out, columns=["folder", "code", "label", "value", "file_name"])

    def close(self) -> None:
        pass


def fold(spark: SparkSession, landing: str, checkpoint: str, sink: str) -> StreamingQuery:
    """Keeps sink/folder=<name> the facts of each folder (code, label, value, file_name), from what parse_changed() landed."""

    def batch(found: DataFrame, _: int) -> None:
        # a folder that a batch puts out several times has its last state in all of them, as a batch is one call for each folder
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(sink)

    landed = spark.readStream.schema(LANDED).option("recursiveFileLookup", "true").parquet(literal_glob(landing))
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # map state needs it
    try:
        found = landed.groupBy("folder").transformWithStateInPandas(FolderFacts(), FOUND, "Update", "None")
        return found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def facts(spark: SparkSession, sink: str) -> DataFrame:
    """FOUND rows of all folders in a sink."""
    return spark.read.schema("code string, label string, value double, file_name string, folder string").parquet(sink).where("code IS NOT NULL").select("folder", "code", "label", "value", "file_name")
