"""Folders of markdown as a DataFrame: folder, file_name, file_ord and content, or lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import lenient_utf8, lines_of


def ordered(files: DataFrame) -> DataFrame:
    """files (folder, path, content) with file_name and file_ord: 1 for the folder's first path, part by part."""
    # paths alone are numbered, so contents aren't sorted
    return files.join(numbered_files(files), ["folder", "path"]).select("folder", F.element_at(F.split("path", "/"), -1).alias("file_name"), "file_ord", "content")


def below(spark: SparkSession, root: str) -> Column:
    """Column `path` of a file source without its root folder: as many characters as the root's full path has, whatever its parts are called."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString().rstrip("/")
    return F.col("path").substr(F.lit(len(full) + 2), F.length("path"))


def literal_glob(path: str) -> str:
    """A path that a file source reads as it is written, though it has characters of a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _files(spark: SparkSession, format: str, folder: str) -> DataFrame:
    return spark.read.format(format).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(literal_glob(folder))


def numbered_files(files: DataFrame) -> DataFrame:
    """folder, path, file_ord: 1 for the folder's first path, part by part."""
    return files.select("folder", "path").distinct().withColumn("file_ord", F.row_number().over(Window.partitionBy("folder").orderBy(F.split("path", "/"))))


def scan(spark: SparkSession, *folders: str) -> DataFrame:  # O-01, O-02
    """All *.md below the folders; each folder is one document set.  Content is read once, as bytes, invalid UTF-8 left out."""
    found = None
    for folder in dict.fromkeys(f.rstrip("/") for f in folders):
        one = _files(spark, "binaryFile", folder).select(F.lit(folder).alias("folder"), below(spark, folder).alias("path"), lenient_utf8(F.col("content")).alias("content"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no folder given")
    return ordered(found)


def scan_lines(spark: SparkSession, *folders: str) -> DataFrame:  # O-01 to O-03, O-150
    """folder, file_name, file_ord, line_no, line of all *.md below the folders, as split_lines() gives them for scan(), without a document ever being one value.

    Files are read in blocks; a line's place is its block's place in the file and its own place in the block, and lines
    are numbered by counting those of the blocks before.
    """
    from ..operators.segments import numbered

    found = files = None
    for folder in dict.fromkeys(f.rstrip("/") for f in folders):
        raw, name = _files(spark, "text", folder), F.lit(folder).alias("folder")
        path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
        made = raw.select("value", F.regexp_replace(path, "^file:/+", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
        one = made.select(name, below(spark, folder).alias("path"), "_block", "_row", F.posexplode(lines_of(lenient_utf8(F.col("value")))).alias("_part", "line"))
        every = _files(spark, "binaryFile", folder).select(name, below(spark, folder).alias("path"))  # files without lines have a number too
        found, files = (one, every) if found is None else (found.unionByName(one), files.unionByName(every))
    if found is None:
        raise ValueError("no folder given")
    lines = numbered(found, ["folder", "path"], ["_row", "_part"], "_block")
    return lines.join(numbered_files(files), ["folder", "path"]).select("folder", "file_ord", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("line_no").cast("int").alias("line_no"), "line")
