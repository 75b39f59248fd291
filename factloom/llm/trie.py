"""The prefix trie of conversations, by partition refinement.

All conversations start in one class, the root.  Each round looks at one more turn and splits every class by it; the
class of a conversation is a digest of its turns so far, so rows find their class without a join.  A class of one
conversation retires at once: the rest of that conversation is a chain of nodes with one member each, which is written
out without looking at its turns.  Only conversations that still share their whole beginning with another stay active.
Then counts fold back from the deepest level to the root.

Turns are rows, never lists, so a long conversation is no large value, and every sum is combined before its shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: A rebuilt conversation starts with turns of the conversation whose id is the last multiple of this.
FAMILY = 100
#: It takes fewer than this many of them.
HEADS = 6
#: Bytes of a piece of a list of ids, and nodes of a chain written at a time.
PIECE, CHAIN = 1 << 16, 4096

_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first, then role and text), h (a digest of role and text), chars (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    named = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("h"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h")
    return named.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "h", "chars")


def heads_of(conv_id: Column, heads: int = HEADS) -> Column:
    """How many turns a rebuilt conversation takes from the head of its family."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(heads)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, h, chars) and lengths (conv_id, n) of the rebuilt conversations, both stored; turnless ones have n 0.

    A conversation's first turns are those of its family's head, as many as heads_of() says or the head has; its own
    follow, without as many of its first as heads_of() says.
    """
    own = stored(turns(conversations), "turns")
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    counts = own.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    convs = counts.select("conv_id", "n_own", base, heads_of(F.col("conv_id")).alias("want"))
    bases = counts.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = stored(convs.join(bases, "base", "left").withColumn("got", F.least("want", F.coalesce("n_base", F.lit(0)))), "convs")
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "h", "chars")
    taken = convs.where("got > 0").select("conv_id", "base", "got").join(first, "base").where("pos < got").select("conv_id", "pos", "h", "chars")
    rest = own.join(convs.select("conv_id", "want", "got"), "conv_id").where("pos >= want")
    rest = rest.select("conv_id", (F.col("pos") - F.col("want") + F.col("got")).alias("pos"), "h", "chars")
    lengths = convs.select("conv_id", (F.col("got") + F.greatest(F.col("n_own") - F.col("want"), F.lit(0))).alias("n"))
    return stored(taken.union(rest).withColumn("band", F.length(F.bin("pos"))).repartition("band", "conv_id").sortWithinPartitions("band", "pos"), "rebuilt"), lengths


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one class, joined by commas into pieces."""
    node, first, ids, size = None, None, [], 0
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
    give = lambda: pa.RecordBatch.from_pylist([{"node": node, "first": first, "piece": ",".join(ids)}], schema)
    for batch in batches:
        for key, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (key != node or size > PIECE):
                yield give()
                ids, size = [], 0
            if not ids:
                node, first = key, conv_id
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
    if ids:
        yield give()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each class, in order, a piece at a time."""
    node, state, found = None, None, []
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        for key, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
            if key != node or state is None:
                if state is not None:
                    found.append({"node": node, "ends_sha256": state.hexdigest()})
                node, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b",")
                state.update(piece.encode())
        yield pa.RecordBatch.from_pylist(found, schema)
        found = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}], schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the SHA-256 of each node's ids in numerical order, joined by commas.

    Ids are sorted and joined into pieces by range, over all tasks; what meets in the task of a node is a row for some
    ten thousand of its ids, and goes through the digest piece by piece.
    """
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(tasks, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node binary, first long, piece string")
    return pieces.repartition(tasks, "node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def _refined(conversations: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Nodes of several members level by level, the tops of single chains, and the ends of the former.

    Levels: node (its digest), parent, conv_id, n_convs, chars.  Tops: conv_id, depth, parent, n (length).  Ends: node, conv_id.
    """
    rows, lengths = rebuilt(conversations)
    active = stored(lengths.select("conv_id", F.unhex(F.lit(_EMPTY)).alias("node"), "n"), "active0")
    whole = active.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    levels = [stored(whole.select("node", F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars")), "level0")]
    tops, ends, depth = [], [active.where("n = 0").select("node", "conv_id")], 0
    while True:
        band = (depth).bit_length() or 1
        turn = rows.where((F.col("band") == band) & (F.col("pos") == depth)).select("conv_id", "h", "chars")
        depth += 1
        step = active.join(turn, "conv_id").select("conv_id", F.col("node").alias("parent"), F.unhex(F.sha2(F.concat("node", "h"), 256)).alias("node"), "chars", "n")
        step = stored(step, f"step{depth}")
        groups = step.groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("n").alias("n"))
        groups = stored(groups, f"groups{depth}")
        single = groups.where("n_convs = 1")
        tops.append(single.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n"))
        level = groups.where("n_convs > 1").select("node", "parent", "conv_id", "n_convs", "chars")
        if level.isEmpty():
            break
        levels.append(level)
        active = stored(step.join(single.select("conv_id"), "conv_id", "left_anti").select("conv_id", "node", "n"), f"active{depth}")
        ends.append(active.where(F.col("n") == depth).select("node", "conv_id"))
    return levels, reduce(DataFrame.union, tops), reduce(DataFrame.union, ends)


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations, the root included.

    conversations: conv_id, turn, role, text; other columns are ignored.  conv_id: the smallest member; depth;
    parent_conv_id: the parent's conv_id, null at the root; n_convs; n_children; n_leaves; saved_tokens; ends_sha256.

    A null conv_id is no conversation, so its rows are left out; null roles and texts are empty.  Turns of equal number
    stand in the order of a digest of role and text; repeated rows are turns of their own.  An empty table has no node.
    """
    levels, tops, ends = _refined(conversations)
    tops = stored(tops, "tops")
    several = stored(ends_digests(ends), "ends")
    chains = tops.groupBy("parent").agg(F.count("*").alias("_tops")).select(F.col("parent").alias("node"), "_tops")
    nothing = F.lit(0).cast("long")
    done, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth].join(chains, "node", "left")
        if below is None:
            level = level.withColumns({"_inner": nothing, "_leaves": nothing, "_saved": nothing})
        else:
            sums = below.groupBy("parent").agg(F.count("*").alias("_inner"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
            level = level.join(sums.withColumnRenamed("parent", "node"), "node", "left")
        zero = lambda c: F.coalesce(c, nothing)
        children = zero("_tops") + zero("_inner")
        level = level.select(
            "node", "parent", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", children.alias("n_children"),
            F.greatest(zero("_tops") + zero("_leaves"), F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars") + zero("_saved")).alias("saved_tokens"),
        )
        below = stored(level, f"node{depth}")
        done.append(below)
    nodes = reduce(DataFrame.union, done)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kept = nodes.join(parents, "parent", "left").join(several, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    block = F.explode(F.sequence(F.col("depth"), F.col("n"), F.lit(CHAIN).cast("long")))
    links = tops.join(parents, "parent").select("conv_id", "parent_conv_id", F.col("depth").alias("top"), "n", block.alias("at"))
    links = links.select("conv_id", "parent_conv_id", "top", "n", F.explode(F.sequence(F.col("at"), F.least(F.col("n"), F.col("at") + CHAIN - 1))).alias("depth"))
    last = F.col("depth") == F.col("n")
    single = links.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), nothing.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return kept.select(*single.columns).union(single)
