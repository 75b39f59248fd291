"""Importance resampling of documents towards a target distribution of hashed word runs.

A feature is a run of 1 to n consecutive words joined by one space, and its bucket is the CRC-32 of its bytes modulo the
number of buckets.  One scan of a document's bytes keeps a ring of running CRC states, one for each of the last n words
at which a run may have begun; each word extends every state by a space and itself, begins one of its own, and each
state is the checksum of a run.  No run is ever built as text.

One pass counts the buckets of the documents and of the target, and the log ratios of these counts (as many as there are
buckets, a parameter) go to all tasks.  A second pass sums them for each document.  Gumbel noise of the doc_id turns the
best scores into a draw without replacement, which a range-partitioned sort ranks: no task and no driver sees all scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored

BUCKETS = 10_000
LONGEST_RUN = 1
SEED = 2024
LEAST_WORDS = 20
DRAWN_PERCENT = 10
#: Bytes of text that are cut into words at a time.
PIECE = 1 << 20

#: Letters of A-Z in lower case, digits and bytes of characters beyond ASCII as they are, all else a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about `PIECE` bytes at a time; a word is never cut."""
    start = 0
    while start < len(text):
        end = start + PIECE
        piece = text[start:end].translate(_WORD_BYTES)
        while end < len(text) and piece[-1] != 32:
            more = text[end : end + 4096].translate(_WORD_BYTES)
            cut = more.find(b" ")
            piece, end = piece + (more if cut < 0 else more[: cut + 1]), end + (len(more) if cut < 0 else cut + 1)
        yield piece.split()
        start = end


def checksums(text: bytes, n: int) -> Iterator[tuple[int, list[int]]]:
    """Number of words, and the CRC-32 of every run of 1 to n words that ends in them, for each piece of a text."""
    crc = zlib.crc32
    ring: list[int] = []
    for words in _words(text):
        if n == 1:
            yield len(words), list(map(crc, words))
            continue
        found: list[int] = []
        for word in words:
            ring = [crc(word, crc(b" ", state)) for state in ring[1 - n :]]
            ring.append(crc(word))
            found += ring
        yield len(words), found


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    for value in texts.cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(texts: DataFrame, n: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column text fall into each bucket; each task puts out its own sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _bytes(batch.column(0)):
                for _, found in checksums(text, n):
                    total += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, a thousand times the log ratio of its smoothed shares in target and source, rounded down."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight (the gains of all features of the text, summed) for each row of docs."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(_bytes(batch.column("text"))):
                for words, found in checksums(text, n):
                    rows[:, k] += words, len(found), gain[np.array(found, np.int64) % buckets].sum()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows)], names=["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, rounded down, from the SHA-256 of seed and doc_id; a null id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, draws: int) -> DataFrame:
    """rows (doc_id, score and more) with `rank`: 1, 2, 3... by falling score, then doc_id (null last), up to `draws`; null beyond.

    Rows are sorted by range over all tasks; the sizes of these ranges, one number for a task, place each range's ranks.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    at = stored(dealt.select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place") + 1
    found = at.join(F.broadcast(sizes), "_range")  # at most a row for each task
    return found.select(*[c for c in rows.columns], F.when(rank <= draws, rank).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, n: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank is null for documents that aren't drawn.

    docs has doc_id and text, target has text; other columns are ignored.  A null or empty text has no features and weight
    0.  Repeated rows and rows of one doc_id are documents of their own, with equal scores where texts are equal, in any
    order among equals.  A null doc_id has the noise of an empty one and comes last among ties.  Empty tables give an
    empty table; an empty target leaves all its counts 0.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    scored = stored(weighed(docs, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(enough, percent * enough.count() // 100)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
