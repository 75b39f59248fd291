"""Incremental ingest: new markdown files arrive as a stream, and the folders they belong to are extracted anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import lenient_utf8
from ..sources.documents import below, literal_glob, ordered
from ..sources.staged import staged

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, root: str, most_files: int = 10_000) -> DataFrame:
    """A stream of root/<folder>/**.md: folder, path, content."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", most_files).load(literal_glob(root))
    return keyed(raw, root)


def keyed(raw: DataFrame, root: str, *more: Column | str) -> DataFrame:
    """folder, path, content and more of files below root's folders; files of the root itself are in none."""
    rel = raw.withColumn("path", below(raw.sparkSession, root)).where(F.col("path").contains("/"))
    folder = F.substring_index("path", "/", 1)
    return rel.select(folder.alias("folder"), F.col("path").substr(F.length(folder) + 2, F.length("path")).alias("path"), lenient_utf8(F.col("content")).alias("content"), *more)


def _removed(spark: SparkSession, sink: str, folder: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{sink}/folder={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(folder)}")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def extract_changed(spark: SparkSession, root: str, checkpoint: str, sink: str, extract: Callable[[DataFrame], DataFrame], most_files: int = 10_000) -> StreamingQuery:
    """For each batch of at most `most_files` new files, extract(docs) over all files of the folders they are in.

    Results (with a column folder) are kept in sink/folder=<name>: those of a changed folder replace the ones before, so a
    repeated batch changes nothing, and only the files of changed folders are read.
    """

    def batch(new: DataFrame, number: int) -> None:
        changed = [r.folder for r in new.select("folder").distinct().collect()]  # most_files at most
        if not changed:
            return
        every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load([literal_glob(f"{root.rstrip('/')}/{f}") for f in changed])
        rows = staged(extract(ordered(keyed(every, root))), "extracted")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(sink)
        for folder in set(changed) - {r.folder for r in rows.select("folder").distinct().collect()}:
            _removed(spark, sink, folder)  # it has no rows any more

    return files(spark, root, most_files).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
