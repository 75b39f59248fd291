"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sizes are words.  The mix has `share` of all words; sources share it by weight, none above `most` times its own
   size, and what is over is shared again among the others.
2. Each source is a stream: its documents in an order given by a hash of their ids and texts, as often as needed, cut
   into blocks of equally many words: `BLOCK`, or less for a source whose target has fewer than `LEAST_BLOCKS` of them.
   A document's place in the stream is a prefix sum.
3. The schedule has as many slots as blocks are wanted.  Slot k has the point k * golden ratio mod 1 (exact, in 64-bit
   integers); the source whose interval of cumulative weights (its wanted blocks) holds it fills the slot.  Any stretch
   of the schedule has the sources near their weights.
4. Slots are ranked within their source by a prefix sum over chunks of slots; slot r of a source takes block r of its
   stream, modulo the stream's length.  A document gives as many words as its pieces in taken blocks have.

A small source has a few hundred slots of its own smaller blocks, so the number of slots follows the size of the mix and
the number of sources, whatever the smallest source is.  A row for each source, some 50 bytes, reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, WORD, running, stored

WEIGHTS = (3, 1, 2)
GOLDEN = 0x9E3779B97F4A7C15
CHUNK = 1 << 14
BLOCK, LEAST_BLOCKS = 4096, 400


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words of each source: share of all, by weight, at most `most` times its size; the excess is shared again."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    open_ = [k for k, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total >= most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return out


def block_words(goal: float) -> int:
    """Words of a block of a source: BLOCK, or so few that the target has LEAST_BLOCKS of them."""
    return int(min(BLOCK, max(1, goal // LEAST_BLOCKS)))


def schedule(spark, wanted: list[int]) -> DataFrame:
    """k (slot), chunk, source_no: the golden-ratio point of each slot through the cumulative numbers of wanted blocks."""
    slots = sum(wanted)
    edges = np.cumsum(np.array(wanted, np.float64)) / (slots or 1)

    def points(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            u = (k.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            at = np.minimum(np.searchsorted(edges, u, "right"), len(edges) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k // CHUNK), pa.array(at.astype(np.int32))], ["k", "chunk", "source_no"])

    return spark.range(slots).mapInArrow(points, "k long, chunk long, source_no int")


def ranked(slots: DataFrame) -> DataFrame:
    """slots with r: how many slots of the same source come before."""
    counts = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("k")) - 1
    return slots.join(starts, ["source_no", "chunk"]).withColumn("r", F.col("start") + within).select("k", "source_no", "r")


def mixed(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, and the columns in `keep`.

    `most` must be whole, as a block is taken whole or not at all; another raises ValueError.
    size: words of the text (null: 0).  taken: words that the mix takes of it, repeats counted, at most `most` times
    size.  Sources in code point order, null last, have the weights in turn.  A source without words has target 0.
    Rows of equal doc_id are documents of their own; equal rows share what the mix takes of them in any order.  An empty
    table gives an empty result.
    """
    if most < 1 or most != int(most):
        raise ValueError(f"most is {most}; a document can be taken a whole number of times at most")
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("mix"))
    row = F.struct(*keep) if keep else F.lit(None).cast("string")
    slim = stored(docs.select("doc_id", "source", size.alias("size"), h.alias("h"), row.alias("row")), "sizes")
    found = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sizes = [r.n for r in found]
    goals = targets(sizes, [float(weights[k % len(weights)]) for k in range(len(found))], share, most)
    blocks = [block or block_words(g) for g in goals]
    wanted = [int(-(-g // b)) for g, b in zip(goals, blocks)]
    facts = spark.createDataFrame(
        [(r.source, k, r.n, goals[k], blocks[k], -(-r.n // blocks[k])) for k, r in enumerate(found)], "source string, source_no int, source_size long, target double, width long, blocks long"
    )
    near = F.broadcast if len(found) <= BROADCAST_ROWS else lambda x: x
    known = slim.join(near(facts), slim.source.eqNullSafe(facts.source)).select("doc_id", slim.source, "size", "h", "row", "source_no", "source_size", "target", "width", "blocks")
    # where each document starts in its source's stream
    placed = stored(running(known, "source_no", "h", "size", "start").drop("h"), "placed")
    w = F.col("width")
    cut = placed.where("size > 0").select(
        "source_no", "start", "size", "width", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("start") + F.col("size") - 1) / w))).alias("block")
    )
    cut = cut.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * w) - F.greatest(F.col("start"), F.col("block") * w))
    slots = ranked(schedule(spark, wanted))
    # a block is taken once for each slot that lands on it, at most `most` times
    times = (
        slots.join(near(facts.select("source_no", "blocks")), "source_no")
        .groupBy("source_no", F.pmod("r", "blocks").alias("block"))
        .agg(F.least(F.count("*"), F.lit(int(most))).alias("times"))
    )
    taken = cut.join(times, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = ["doc_id", "source", "size", "source_size", "target"]
    more = [F.col("row")[c].alias(c) for c in keep]
    some = placed.where("size > 0").join(taken, ["source_no", "start"], "left").select(*out, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *more)
    none = placed.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"), *more)
    return some.union(none)
