"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a table of facts up to which it is broadcast, at some 60 bytes a row.
BROADCAST_ROWS = 100_000

#: Words of the word contract: runs without space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bits of a bitmap of hashes, of 8 MB.
BITMAP_BITS = 1 << 26
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names; where it names none in local mode (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder, and a cluster has no other")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"factloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are of `BATCH_BYTES` at most, as texts may be long and a task holds a few batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def rested(spark: SparkSession) -> None:
    """The driver's Python and its JVM give back what past jobs left: models, plans, generated classes, broadcasts.

    A JVM lets garbage fill its heap before it collects any, and broadcasts of past jobs stay until it does.
    """
    gc.collect()
    give_back()
    spark._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """The driver's JVM gives back what is free of its memory outside the heap; False where a JVM has no command for that.

    Its compilers, codecs and threads come and go with each job, and the allocator keeps what they leave: no collection
    of garbage returns it, and no limit of the heap bounds it.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    of, kinds, args = jvm.java.lang.Class.forName, array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    kinds[0], kinds[1] = of("javax.management.ObjectName"), of("java.lang.String")
    kinds[2], kinds[3] = of("[Ljava.lang.Object;"), of("[Ljava.lang.String;")
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # the server's own class isn't public, so its method is that of the interface
        of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def grown(spark: SparkSession) -> bool:
    """Whether the driver's JVM holds half or more of the heap that it may take, used or not."""
    heap = spark._jvm.Runtime.getRuntime()
    return 2 * heap.totalMemory() >= heap.maxMemory()


def frugal(run: Callable) -> Callable:
    """A function of Arrow batches whose task gives memory back after each batch and at its end: Python workers stay between tasks, idle ones too."""

    def wrapped(batches):
        try:
            for out in run(batches):
                yield out
                del out
                give_back()
        finally:
            give_back()

    return wrapped


def stored(df: DataFrame, name: str = "table", folder: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and a lost executor loses none of it.

    What planned and ran it is garbage then.  A long chain of such jobs would fill the driver's heap with it, beside all
    that a JVM holds outside its heap, so the driver rests where the heap has grown, and gives back free memory outside it
    in any case.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if grown(spark):
        rested(spark)
    else:
        trimmed(spark)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or with more underscores, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result is about to add; names match in any case, as Spark's do."""
    wanted = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of `bits` bits, whatever the number of hashes (a long column h): for each hash its bit is 1."""
    width = 32768
    at = F.pmod(F.col("h"), F.lit(bits))
    maps = hashes.select(at.alias("p")).groupBy(F.floor(F.col("p") / width).alias("k")).agg(F.bitmap_construct_agg((F.col("p") % width).cast("long")).alias("m")).toArrow()
    found = dict(zip(maps["k"].to_pylist(), maps["m"].to_pylist()))
    return np.frombuffer(b"".join(found.get(k, bytes(width // 8)) for k in range(bits // width)), np.uint8)


def in_bitmap(spark: SparkSession, flat: np.ndarray) -> Callable[[Column], Column]:
    """Whether the bit of a hash is 1, as a function of a column: true for every hash of the bitmap, and for few others while most bits are 0."""
    held, bits = spark.sparkContext.broadcast(flat), 8 * len(flat)

    @F.arrow_udf("boolean")
    def hit(p: pa.Array) -> pa.Array:
        at = p.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 3] >> (at & 7)) & 1 > 0)

    return lambda h: hit(F.pmod(h, F.lit(bits)))


def named_files(uri: str, manifest: str | None, column: str, endings: tuple[str, ...]) -> list[str]:
    """Paths of a data source's files, for its planner: those of a manifest table's column, or those found under the URI."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    if manifest:
        store, at = fs.FileSystem.from_uri(manifest)
        return sorted(ds.dataset(at, filesystem=store, format="parquet", exclude_invalid_files=False).to_table(columns=[column])[column].to_pylist())
    store, at = fs.FileSystem.from_uri(uri)
    if store.get_file_info(at).type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.endswith(endings))


def running(rows: DataFrame, group: str, key: str, value: str, out: str) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows of the same `group` that come before, in order of `key`, a 64-bit hash.

    Rows of equal key may come in any order among themselves.  No task needs all rows of a group or of a key: rows of a
    key are cut by the partition that holds them, the sums of these pieces are ordered within 4096 ranges of a group, and
    the sums of ranges within the group.
    """
    piece = fresh_name(rows, "_piece")
    base = stored(rows.withColumn(piece, F.pmod(F.spark_partition_id(), F.lit(1024))), "rows")
    high = F.shiftrightunsigned(F.col(key), 52)
    sums = stored(base.groupBy(group, key, piece).agg(F.sum(value).alias("_n")).select(group, key, piece, high.alias("_range"), "_n"), "sums")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.groupBy(group, "_range").agg(F.sum("_n").alias("_n")).withColumn("_base", before(Window.partitionBy(group).orderBy("_range"))).drop("_n")
    starts = sums.withColumn("_inside", before(Window.partitionBy(group, "_range").orderBy(key, piece))).join(ranges, [group, "_range"])
    starts = starts.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(piece).alias("_c"), (F.col("_base") + F.col("_inside")).alias("_start"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(group, key, piece).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = base.withColumn(out, own)
    joined = found.join(starts, [found[group].eqNullSafe(starts["_g"]), found[key] == starts["_k"], found[piece] == starts["_c"]])
    return joined.select(*[found[c] for c in rows.columns if c != out], (found[out] + starts["_start"]).cast("long").alias(out))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """At most `rows` labelled documents outside the held-out fold: doc_id, text, label (0 or 1), stored.

    The sample is the rows of smallest hash of doc_id.  Several labels of a document count as their maximum and
    several texts of a doc_id as the greatest; null ids, other labels and null texts are left out.
    """
    small_batches(docs.sparkSession)
    fold = remainder(F.col("doc_id"), modulus)
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(fold.isNotNull() & (fold != held_out) & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    return stored(sample, "sample")
