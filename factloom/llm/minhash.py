"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each text becomes the set of its 5-word shingles (64-bit hashes), a digest of its sequence of words, `BANDS` band keys
   of `ROWS` minima each, and a signature of the low bytes of all minima.
2. Texts of equal words form a class; its smallest doc_id stands for it.  Only classes are compared.
3. Classes that share a band key are candidates.  Round one compares each with one leader of the key, the class that
   shares the most keys, so a group of near copies costs as many pairs as it has members.  Its links give components.
   Round two compares what still shares a key across components: a key of at most `CROWD` classes gives its pairs; the
   classes of larger keys are joined by an exact prefix filter (any two linked sets share a shingle among the rarest
   quarter of each, and at the first such shingle what is left of both is still long enough), which gives few pairs
   even where thousands of half-alike texts share a key.  So no pair between components is left out.
4. A candidate pair's signatures are compared in batches.  After each, a pair goes when the posterior probability that
   its similarity reaches the threshold (uniform prior) is below the chosen miss probability.  Survivors are verified
   on their full shingle sets, with words and shingles told apart by their text, not by a hash; only these links count.
5. Components of the links, by star rounds over tables in the shared folder.

Pairs, links and components stay in Spark.  What the driver holds is a bitmap of fixed size (`BITMAP_BITS`), which spares
texts that no survivor needs from the shuffle; false hits of it are dropped by the join that follows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from .common import bitmap, frugal, in_bitmap, small_batches, stored
from .components import components

WORDS = 5
BANDS, ROWS = 64, 6
BATCH = 32
MISS = 1e-6
CROWD = 32
_COUNTS, _PART = 1 << 20, 1 << 15
_SHINGLES = 1 << 15

PREPARED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their number per text."""
    hashes, counts = K.words(texts, lower=True)
    found, sizes = K.ngrams(hashes, counts, words)
    ends = np.cumsum(sizes)
    word_ends = np.cumsum(counts)
    sets, n = [], np.zeros(len(counts), np.int64)
    for d in range(len(counts)):
        if sizes[d]:
            s = np.unique(found[ends[d] - sizes[d] : ends[d]])
        elif counts[d]:
            s = K.ngrams(hashes[word_ends[d] - counts[d] : word_ends[d]], counts[d : d + 1], int(counts[d]))[0]
        else:
            continue
        sets.append(s)
        n[d] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), n


def exact_shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text as numbers, and their number per text: equal in all of texts where, and only where, the shingles are."""
    data, bounds = K.raw(texts)
    data, bounds = K.LOWER[data[bounds[0] : bounds[-1]]], bounds - bounds[0]
    start, end = K.tokens(data, bounds, None)
    counts = np.diff(np.searchsorted(start, bounds))
    spans = np.concatenate([[0], np.cumsum(end - start)])
    word = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(spans.astype(np.int64)), pa.py_buffer(data[~K.SPACE[data]])])
    number = word.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    # a text of fewer words is one sequence, filled up with 0
    sizes = np.where(counts > 0, np.maximum(counts, words), 0)
    stream = np.zeros(int(sizes.sum()), np.int64)
    ends, before = np.cumsum(sizes), np.cumsum(counts) - counts
    stream[np.arange(len(number)) + np.repeat(ends - sizes - before, counts)] = number
    n = np.maximum(sizes - words + 1, 0)
    at = np.arange(int(n.sum())) + np.repeat(ends - sizes - (np.cumsum(n) - n), n)
    key, top = stream[at], len(number) + 1
    for k in range(1, words):
        key = pa.array(key * top + stream[at + k]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum(n)
    sets = [np.unique(key[e - m : e]) for e, m in zip(cuts, n)]
    return (np.concatenate(sets) if sets else np.zeros(0, np.int64)), np.array([len(x) for x in sets], np.int64)


def word_digests(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit digests of the lower-cased words of each text, one blank between them."""
    data = K.LOWER[data[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    space = K.SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    before[bounds[:-1][bounds[:-1] < len(data)]] = True
    keep = ~(space & before)
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]
    data = np.where(space, np.uint8(32), data)[keep].tobytes()
    return [hashlib.blake2b(data[s:e].rstrip(b" "), digest_size=16).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def _coefficients(n: int) -> np.ndarray:
    return K.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).astype(np.uint32) | np.uint32(1)


def minima(sets: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """n minima (uint32) of each non-empty set; a set is one column."""
    full = sizes[sizes > 0]
    out = np.empty((n, len(full)), np.uint32)
    starts = np.concatenate([[0], np.cumsum(full)])
    a = _coefficients(n)
    s = 0
    while s < len(full):
        e = max(s + 1, int(np.searchsorted(starts, starts[s] + _SHINGLES, "right")) - 1)
        x = (sets[starts[s] : starts[e]] >> np.uint64(32)).astype(np.uint32)
        at = starts[s:e] - starts[s]
        v, t = np.empty_like(x), np.empty_like(x)
        for k in range(n):
            np.multiply(x, a[k], out=v)
            np.right_shift(v, 15, out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
            out[k, s:e] = np.minimum.reduceat(v, at)
        s = e
    return out


def prepared(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    @frugal
    def run(batches):
        for b in batches:
            texts = b.column("text")
            data, bounds = K.raw(texts)
            for i, j in K.groups(bounds, 4 * K.BLOCK):
                sets, n = shingle_sets(texts.slice(i, j - i), words)
                digests = word_digests(data, bounds[i : j + 1])
                m = minima(sets, n, bands * rows)
                full = np.flatnonzero(n)
                keys = np.zeros((bands, len(full)), np.uint64)
                for k in range(bands * rows):
                    keys[k // rows] = keys[k // rows] * np.uint64(0xF1357AEA2E62A9C5) + m[k]
                keys = K.mix(keys + K.mix(np.arange(1, bands + 1, dtype=np.uint64))[:, None])
                low = np.ascontiguousarray((m & np.uint32(255)).astype(np.uint8).T)
                sigs, fps, lists = [None] * (j - i), [None] * (j - i), [None] * (j - i)
                keys = np.ascontiguousarray(keys.T).view(np.int64)
                for c, d in enumerate(full):
                    fps[d], sigs[d], lists[d] = digests[d], low[c].tobytes(), keys[c]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], PREPARED.fieldNames())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREPARED)


def fewest_matches(total: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, fewest matches in n to go on): below it, P(match rate >= threshold | matches) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _survivors(pairs: DataFrame, prep: DataFrame, percent: int, miss: float, total: int) -> DataFrame:
    """Pairs that the sequential test and the bound by set sizes let through."""
    t = percent / 100
    steps = fewest_matches(total, BATCH, t + (1 - t) / 256, miss)

    @frugal
    def run(batches):
        for b in batches:
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            left = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, total) for c in ("sa", "sb"))
            matches, start = np.zeros(len(na), np.int64), 0
            for n, fewest in steps:
                if not len(left):
                    break
                matches[left] += (sa[left, start:n] == sb[left, start:n]).sum(axis=1)
                left, start = left[matches[left] >= fewest], n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(left)), b.column(1).take(pa.array(left))], ["a", "b"])

    side = prep.select("doc_id", "n_shingles", "sig")
    a = side.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    b = side.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose doc_id is in wanted (v), and few others."""
    hit = in_bitmap(docs.sparkSession, bitmap(wanted.select(F.xxhash64("v").alias("h"))))
    return docs.where(hit(F.xxhash64(F.col("doc_id").cast("long"))))


def _links(survivors: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Survivors whose full shingle sets are alike enough."""
    ids = survivors.select(F.col("a").alias("v")).union(survivors.select(F.col("b").alias("v"))).distinct()
    texts = among(docs, ids).select(F.col("doc_id").cast("long").alias("v"), "text")

    @frugal
    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            ta, tb = b.column("ta"), b.column("tb")
            _, bounds = K.raw(ta)
            for i, j in K.groups(bounds, 4 * K.BLOCK):
                m = j - i
                sets, n = exact_shingles(pa.concat_arrays([ta.slice(i, m), tb.slice(i, m)]), words)
                ends = np.cumsum(n)
                for k in range(m):
                    x, y = sets[ends[k] - n[k] : ends[k]], sets[ends[m + k] - n[m + k] : ends[m + k]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    a = texts.select(F.col("v").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("v").alias("b"), F.col("text").alias("tb"))
    return survivors.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _rarity(crowd: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur in the texts of crowd, by 20 bits of their hash: a table of fixed size, only used to order shingles."""

    @frugal
    def counted(batches):
        counts = np.zeros(_COUNTS, np.uint32)
        for b in batches:
            _, bounds = K.raw(b.column("text"))
            for i, j in K.groups(bounds, 4 * K.BLOCK):
                np.add.at(counts, (shingle_sets(b.column("text").slice(i, j - i), words)[0] >> np.uint64(44)).astype(np.int64), np.uint32(1))
        if counts.any():
            for c in range(_COUNTS // _PART):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([counts[c * _PART : (c + 1) * _PART].tobytes()], pa.binary())], ["part", "counts"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32) for c in t["counts"].to_pylist())
        return pa.table({"part": t["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = crowd.mapInArrow(counted, "part int, counts binary").groupBy("part").applyInArrow(summed, "part int, counts binary").toArrow().sort_by("part")
    return np.frombuffer(b"".join(parts["counts"].to_pylist()), np.uint32) if parts.num_rows else np.zeros(_COUNTS, np.uint32)


def _crowded_pairs(crowd: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): a superset of the linked pairs across components among crowd (v, component, text)."""
    rarity = crowd.sparkSession.sparkContext.broadcast(_rarity(crowd, words))

    @frugal
    def prefixes(batches):
        for b in batches:
            _, bounds = K.raw(b.column("text"))
            for i, j in K.groups(bounds, 4 * K.BLOCK):
                sets, n = shingle_sets(b.column("text").slice(i, j - i), words)
                ends, out = np.cumsum(n), []
                for d in np.flatnonzero(n):
                    s = sets[ends[d] - n[d] : ends[d]]
                    s = s[np.lexsort((s, rarity.value[(s >> np.uint64(44)).astype(np.int64)]))]
                    out.append(s[: n[d] - -(-percent * n[d] // 100) + 1])
                if out:
                    some = i + np.flatnonzero(n)
                    sizes = np.array([len(x) for x in out])
                    at = pa.array(np.repeat(some, sizes))
                    place = np.concatenate([np.arange(k) for k in sizes])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), b.column("v").take(at), b.column("component").take(at), pa.array(place), pa.array(np.repeat(n[n > 0], sizes))], ["g", "v", "c", "place", "n"])

    rows = crowd.select("v", "component", "text").mapInArrow(prefixes, "g long, v long, c long, place long, n long")
    x, y = (rows.select("g", *[F.col(k).alias(k + side) for k in ("v", "c", "place", "n")]) for side in "xy")
    left = F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey"))
    long_enough = (100 + percent) * left >= percent * (F.col("nx") + F.col("ny"))
    return x.join(y, "g").where((F.col("vx") < F.col("vy")) & (F.col("cx") != F.col("cy")) & long_enough).select(F.col("vx").alias("a"), F.col("vy").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = 75, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.  A null, empty or
    wordless text has no shingle and links with nothing.  Rows of equal doc_id are one vertex and get the same
    component; a row without doc_id links with nothing, has no component_id and is kept.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    prep = stored(prepared(docs, words, bands, rows), "prepared")
    some = prep.where("doc_id IS NOT NULL AND n_shingles > 0")
    # tables of one row a class or key are stored, so that Spark may split the joins with them where a class or key is hot
    classes = stored(some.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    member = stored(prep.select("doc_id", "n_shingles", "fp").join(classes, "fp", "left").select("doc_id", "n_shingles", "rep"), "member")
    # a doc_id is one vertex: its texts' classes are linked, and its rows without shingles go with the others
    held = member.where("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    own = member.join(held.where("lo < hi"), "doc_id").where("rep > lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    bare = F.col("doc_id").isNotNull() & F.col("rep").isNull()
    member = member.where(~bare).union(member.where(bare).drop("rep").join(held.select("doc_id", "lo"), "doc_id", "left").select("doc_id", "n_shingles", "lo"))
    first = classes.select("fp", F.col("rep").alias("doc_id"))
    key = some.join(first, ["fp", "doc_id"]).dropDuplicates(["fp", "doc_id"]).select(F.col("doc_id").alias("v"), F.explode(F.array_distinct("bands")).alias("key"))
    key = stored(key, "keys")
    common = stored(key.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "common")
    shared = stored(key.join(common, "key").distinct(), "shared")
    popular = shared.groupBy("v").agg(F.sum("c").alias("pop"))
    ranked = shared.select("v", "key").join(popular, "v")
    leader = ranked.groupBy("key").agg(F.max(F.struct("pop", -F.col("v"))).alias("x")).select("key", (-F.col("x.col2")).alias("w"))
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = shared.select("v", "key").join(stored(leader, "leader"), "key").where("v <> w").select(*ordered("v", "w")).distinct()
    star = stored(star, "star")
    one = stored(_links(stored(_survivors(star, some, percent, miss, bands * rows), "survivors"), docs, words, percent), "links")
    near = components(one)

    labelled = shared.select("v", "key").join(near, "v", "left").select("key", "v", F.coalesce("component", "v").alias("component"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    still = stored(labelled.join(stored(open_keys, "openkeys"), "key"), "open")
    few = still.where(F.col("n") <= CROWD)
    x, y = few.select("key", F.col("v").alias("v"), F.col("component").alias("cv")), few.select("key", F.col("v").alias("w"), F.col("component").alias("cw"))
    across = x.join(y, "key").where("cv < cw").select(*ordered("v", "w")).distinct()
    many = still.where(F.col("n") > CROWD).select("v", "component").distinct()
    texts = among(docs, many).select(F.col("doc_id").cast("long").alias("v"), "text").join(many, "v")
    across = across.union(_crowded_pairs(stored(texts, "crowd"), words, percent)).distinct().join(star, ["a", "b"], "left_anti")
    two = _links(stored(_survivors(across, some, percent, miss, bands * rows), "survivors"), docs, words, percent)
    near = components(one.union(two).union(own))
    return (
        member.join(near.withColumnRenamed("v", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
