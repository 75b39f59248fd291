"""Tables written once in the shared folder and read back, where many branches of a plan need what is costly to make.

Parsing documents is a chain of windows; a plan that repeats it for each branch grows with the branches, in size and in
work.  A staged table ends that chain: what follows plans from a Parquet scan, prunes its columns, and survives a lost
executor.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names; where it names none in local mode (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder, and a cluster has no other")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"factloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_leave, spark)
    _MADE.append(path)
    return path


def _leave(spark: SparkSession) -> None:
    """Deletes the staged tables of this process: results are read from them until it ends, and nobody else knows them."""
    for path in _MADE:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
