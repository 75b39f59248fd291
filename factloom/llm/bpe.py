"""Byte-level BPE encoding and decoding.

Encoding folds ranked merges over the bytes of each distinct word of the corpus, once, with Spark's higher-order
functions and a literal map of ranks:

1. Documents are cut into words (matches of the pattern) where they lie, block by block with array operations.  Each
   task numbers the distinct words of a chunk of its documents (about `CHUNK_BYTES` of text) and stores documents as
   numbers.
2. The words of all chunks meet by hash, in packed lists; each distinct word is folded: its byte array becomes an array
   of tokens with the rank of each and its neighbour, and each step joins the pair of lowest rank, the leftmost of
   equals, until no pair has a rank.  Ranks come from a literal map of token pairs, an array with perfect hashing.
   As the pattern's library does, a word that is a token as a whole is taken as that token.  A word of more than
   `LONG` bytes, where steps over the whole array would cost the square of its length, is merged with a heap.
3. The ids go back to the chunks that hold the word, as a dictionary for each chunk in the shared folder; documents
   are assembled from their numbers and the dictionary of their chunk.

Only distinct words of chunks travel between tasks, no text and no occurrence.  Decoding concatenates the byte pieces of
a document's ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import frugal, give_back, shared_dir, small_batches, stored

CHUNK_BYTES = 32 << 20
#: Bytes of text for each bucket of words; a bucket's distinct words take no more than these bytes, and some 100 more for each word.
BUCKET_BYTES = 64 << 20
_PLACE = 8
LONG = (1 << _PLACE) - 1
_ALL = 1 << 30
_BLOCK = 1 << 20
_SLICE, _SOME = 500, 1 << 16

#: The one pattern that words() cuts with array operations; others go through a regular expression.  Fixed value.
QUICK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a file of base64 token and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# --- words


@cache
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    r"""Where the class of code points changes, and the classes: \s, \p{L}, \p{N} as the tokenizer library knows them, and the rest."""
    import tiktoken

    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\s", _SPACE), (r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(text)
        kinds[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
    edges = np.flatnonzero(np.diff(kinds)) + 1
    return np.concatenate([[0], edges]), kinds[np.concatenate([[0], edges])]


def _cuts(points: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the matches of QUICK_PATTERN in texts of code points that end at `ends` (the last is the length), and at the end the length."""
    n = len(points)
    kind = kinds[points]
    first = np.zeros(n + 1, bool)
    first[0] = first[n] = True
    first[ends] = True
    text_end = first.copy()
    np.logical_or(first[1:n], kind[1:] != kind[:-1], out=first[1:n])
    start = np.flatnonzero(first[:n])
    end = np.append(start[1:], n)
    run = kind[start]
    inside = ~text_end[end]  # the run is followed by another one of its text
    # white space before something: its last character begins the next match, as part of it where it is a blank
    last = end[(run == _SPACE) & inside] - 1
    blank = points[last] == 0x20
    first[last] = True
    first[last[blank] + 1] = False
    # 's 't 'm 'd 're 've 'll where the apostrophe begins a match
    at = start[(run == _OTHER) & (end - start == 1) & inside]
    at = at[(points[at] == 0x27) & first[at] & (kind[at + 1] == _LETTER)]
    if len(at):
        c = points[at + 1]
        more = np.minimum(at + 2, n - 1)
        pair = (at + 2 < n) & ~text_end[np.minimum(at + 2, n)] & (kind[more] == _LETTER)
        d = points[more]
        one = np.isin(c, [ord(x) for x in "stmd"])
        two = pair & (((c == ord("r")) & (d == ord("e"))) | ((c == ord("v")) & (d == ord("e"))) | ((c == ord("l")) & (d == ord("l"))))
        first[at[one | two] + 1] = False
        for hit, size in ((one, 2), (two, 3)):
            # what is left of the letters begins a match of its own
            first[at[hit] + size] = True
    first[n] = True
    return np.flatnonzero(first)


def _parts(data: np.ndarray, s: int, e: int) -> Iterator[tuple[int, int]]:
    """A long text in parts that end before a blank after an ASCII letter or digit, where a match ends in any case."""
    while e - s > 2 * _BLOCK:
        width, cut = _BLOCK, None
        while cut is None and s + width < e:
            tail = data[s + width - 1 : min(e, s + 2 * width)]
            found = np.flatnonzero((tail[1:] == 0x20) & (K.KIND[tail[:-1]] == 1) & (tail[:-1] < 128))
            cut = s + width + int(found[0]) if len(found) else None
            width *= 2
        if cut is None:
            break
        yield s, cut
        s = cut
    yield s, e


def quick_words(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the number of words of each text."""
    data, bounds = K.raw(texts)
    starts, place = [], np.int32 if bounds[-1] < 1 << 31 else np.int64
    for i, j in K.groups(bounds, _BLOCK):
        for s, e in _parts(data, int(bounds[i]), int(bounds[j])) if j - i == 1 else [(int(bounds[i]), int(bounds[j]))]:
            if s == e:
                continue
            block = data[s:e]
            ends = (bounds[i + 1 : j + 1] - s) if j - i > 1 else np.array([e - s])
            if block.max() < 128:
                cuts = _cuts(block, ends, kinds)
            else:
                at = np.append(np.flatnonzero((block & 0xC0) != 0x80), len(block))  # where characters begin
                cuts = at[_cuts(np.frombuffer(block.tobytes().decode("utf-8").encode("utf-32-le"), "<u4"), np.searchsorted(at, ends), kinds)]
            starts.append((cuts[:-1] + s).astype(place))
    cuts = np.concatenate([*starts, bounds[-1:].astype(place)])
    words = pa.Array.from_buffers(pa.binary() if place == np.int32 else pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(cuts[:-1], bounds))


def pattern_words(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """The same for any pattern; its Unicode classes are those of the regex module."""
    import regex

    find = regex.compile(pattern).findall
    found = [[w.encode("utf-8") for w in find(text.as_py() or "")] for text in texts]
    return pa.array([w for words in found for w in words], pa.large_binary()), np.array([len(words) for words in found], np.int64)


# --- ranks


def pairs_of(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (left * n + right, n above all ranks) and ranks of all pairs of tokens that make a token."""
    n = max(ranks.values()) + 1
    found = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                found[left * n + right] = rank
    return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)


def _prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def displaced(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Perfect hashing: shifts, the slot of each key, which is (key % slots + shifts[key % len(shifts)]) % slots, and the slots as an array of zeros.

    Two keys below `top` never agree in both remainders, as the moduli are prime and their product is at least `top`.
    """
    few = _prime(max(len(keys) // 3, 16))
    many = _prime(max(int(1.3 * len(keys)), -(-top // few), 16))
    if many == few:
        many = _prime(many + 1)
    shifts, used, slot = np.zeros(few, np.int64), np.zeros(many, bool), np.zeros(len(keys), np.int64)
    order = np.argsort(keys % few, kind="stable")
    sizes = np.bincount(keys % few, minlength=few)
    ends = np.cumsum(sizes)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        mine = order[ends[b] - sizes[b] : ends[b]]
        place, d, width = keys[mine] % many, 0, 64
        while True:
            tried = (place[:, None] + np.arange(d, d + width)) % many
            free = np.flatnonzero(~used[tried].any(axis=0))
            if len(free):
                break
            d, width = d + width, 4096
        shifts[b], slot[mine] = d + free[0], tried[:, free[0]]
        used[slot[mine]] = True
    return shifts, slot, np.zeros(many, np.int64)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: the finish of an aggregate over nothing, which copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def _literal(values: np.ndarray, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values.tolist(), separators=(",", ":"))), f"array<{kind}>")


class RankMap:
    """A literal map of ranks: pair keys to ranks, for Column expressions."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 1
        self.bits = self.n.bit_length()
        if 3 * self.bits > 62 or 2 * self.bits + 2 * _PLACE + 2 > 62:
            raise ValueError("too many tokens for pair keys of 64 bits")
        keys, found = pairs_of(ranks)
        shifts, slot, table = displaced(keys, self.n * self.n)
        table[slot] = (keys << self.bits) | found
        self.few, self.many = len(shifts), len(table)
        self.literals = [_literal(x, "bigint") for x in (shifts, table, np.array([ranks[bytes([b])] for b in range(256)]))]

    def within(self, body: Callable[[], Column]) -> Column:
        """body(), where the map is at hand: each literal stands in the plan once, however often it is read."""

        def bound(shifts: Column, table: Column, first: Column) -> Column:
            self.shifts, self.table, self.bytes = shifts, table, first
            return body()

        a, b, c = self.literals
        return _let(a, lambda x: _let(b, lambda y: _let(c, lambda z: bound(x, y, z))))

    def key(self, left: Column, right: Column) -> Column:
        return left * F.lit(self.n).cast("long") + right

    def rank(self, key: Column) -> Column:
        """The rank of a pair key; 2 ** bits or more where it has none, null for null."""
        many = F.lit(self.many).cast("long")
        slot = (key % many + F.get(self.shifts, (key % F.lit(self.few).cast("long")).cast("int"))) % many
        return F.get(self.table, slot.cast("int")).bitwiseXOR(F.shiftleft(key, self.bits))


def folded(word: Column, ranks: RankMap) -> Column:
    """Ids of a word given as its array of at most LONG bytes.

    The state is an array of numbers, one for each byte.  That of a token, at its first byte, packs the rank of the
    token and the next one, its place, the place of the next one, and its id, from high bits to low, so the least number
    is the leftmost pair of lowest rank.  The other places of a token are null.
    """
    bits, at, none = ranks.bits, _PLACE, 1 << ranks.bits

    def part(x: Column, low: int, width: int) -> Column:
        return F.shiftright(x, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def token(x: Column) -> Column:
        return x.bitwiseAND(F.lit(none - 1).cast("long"))

    def after(x: Column) -> Column:
        return part(x, bits, at + 1).cast("int")

    def packed(key: Column, place: Column, next_place: Column, id_: Column) -> Column:
        rank = _let(key, lambda k: F.least(ranks.rank(k), F.lit(none).cast("long")))
        high = F.shiftleft(rank, bits + 2 * at + 1).bitwiseOR(F.shiftleft(place.cast("long"), bits + at + 1))
        return high.bitwiseOR(F.shiftleft(next_place.cast("long"), bits)).bitwiseOR(id_)

    def joined(s: Column, m: Column, p: Column, q: Column) -> Column:
        def place(r: Column) -> Column:
            own = packed(ranks.key(m, token(F.get(s, r))), p, r, m)

            def moved(x: Column, k: Column) -> Column:
                return F.when(k == p, own).when(k == q, F.lit(None).cast("long")).when(after(x) == p, packed(ranks.key(token(x), m), k, p, token(x))).otherwise(x)

            return F.transform(s, moved)

        return _let(after(F.get(s, q)), place)

    def step(s: Column, _: Column) -> Column:
        def chosen(x: Column) -> Column:
            into = _let(part(x, bits + at + 1, at).cast("int"), lambda p: _let(after(x), lambda q: joined(s, F.shiftright(x, bits + 2 * at + 1), p, q)))
            return F.when(x < F.lit(none << bits + 2 * at + 1).cast("long"), into).otherwise(s)

        return _let(F.array_min(s), chosen)

    def whole(b: Column) -> Column:
        start = F.transform(b, lambda id_, k: packed(ranks.key(id_, F.get(b, k + 1)), k, k + 1, id_))
        return F.transform(F.filter(F.aggregate(F.slice(b, 2, _ALL), start, step), lambda x: x.isNotNull()), lambda x: token(x).cast("int"))

    return _let(F.transform(word, lambda b: F.get(ranks.bytes, b.cast("int"))), whole)


def heaped(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by a heap of pairs over a linked list, in n log n steps."""
    n = len(word)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        if j >= n or (rank := ranks.get(word[i : end[j]])) is None:
            return None
        return rank, i, end[j]

    heap = [x for x in map(pair, range(n)) if x]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != e:
            continue  # one of the two has been joined since
        j = after[i]
        alive[j], end[i], after[i] = False, e, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# --- tables


CODED = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())])
FOLDING = "bucket int, words array<array<smallint>>, known binary, chunk long, places binary"
_FOLDING = pa.schema([("bucket", pa.int32()), ("words", pa.list_(pa.list_(pa.int16()))), ("known", pa.binary()), ("chunk", pa.int64()), ("places", pa.binary())])


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte plane by byte plane, which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(*parts: bytes) -> bytes:
    return zlib.compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts), 6)


def _unpack(data: bytes) -> list[bytes]:
    data, at, out = zlib.decompress(data), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _listed(words: pa.Array, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Distinct words dealt to buckets by hash: the buckets that have some, and for each its words and their numbers, packed."""
    data, bounds = K.raw(words)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    bucket = (K.word_hashes(data, bounds[:-1], bounds[1:]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    data, bounds = K.raw(words.take(pa.array(order)))
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    used = np.flatnonzero(np.diff(ends, prepend=0))
    packed = []
    for s, e in zip([0, *ends[used[:-1]].tolist()], ends[used].tolist()):
        packed.append(_pack(_planes(np.diff(order[s:e], prepend=0)), _planes(np.diff(bounds[s : e + 1])), data[bounds[s] : bounds[e]].tobytes()))
    return used, packed


def coded(docs: DataFrame, pattern: str, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each document its words as numbers, and for each chunk and bucket of words by hash a packed list of numbers and words."""
    runs = class_runs() if pattern == QUICK_PATTERN else None
    names = CODED.fieldNames()

    @frugal
    def run(batches):
        kinds = np.repeat(runs[1], np.diff([*runs[0], 0x110000])) if runs else None

        def chunked(held: list[pa.RecordBatch]):
            chunk = uuid.uuid4().int >> 66
            texts, ids = (pa.concat_arrays([b.column(c) for b in held]) for c in ("text", "doc_id"))
            held.clear()
            words, counts = quick_words(texts, kinds) if runs else pattern_words(texts, pattern)
            once = words.dictionary_encode()
            numbers, ends = once.indices.to_numpy(), np.cumsum(counts)
            s = 0
            while s < len(texts):
                e = max(s + 1, int(np.searchsorted(ends, ends[s] - counts[s] + _BLOCK, "right")))
                codes = [_planes(numbers[to - n : to]) for to, n in zip(ends[s:e].tolist(), counts[s:e].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * (e - s), pa.int64()), ids.slice(s, e - s), pa.array(codes, pa.binary()), pa.nulls(e - s, pa.int32()), pa.nulls(e - s, pa.binary())], names)
                s = e
            used, packed = _listed(once.dictionary, buckets)
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names)

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= chunk_bytes:
                yield from chunked(held)
                size = 0
        if sum(b.num_rows for b in held):
            yield from chunked(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)


@contextmanager
def _short_plans(spark: SparkSession) -> Iterator[None]:
    """The SQL strings of a plan would each carry the whole literal."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _met(ranks: dict[bytes, int], long: int):
    """Of packed lists in order of bucket: for each list its words that are new to the bucket, in slices to fold or with known ids, and the places of all its words.

    A word's place is twice its number among the bucket's folded words, or twice that among those of known ids and one.
    """

    @frugal
    def run(batches):
        bucket, seen, sizes = None, {}, [0, 0]
        for b in batches:
            for key, chunk, packed in zip(b.column("bucket").to_pylist(), b.column("chunk").to_pylist(), b.column("words")):
                if key != bucket:
                    bucket, seen, sizes = key, {}, [0, 0]
                numbers, lengths, raw = _unpack(packed.as_py())
                ends = np.cumsum(_numbers(lengths)).tolist()
                new: list[bytes] = []
                known: list[list[int]] = []
                places = []
                for s, e in zip([0, *ends], ends):
                    word = raw[s:e]
                    place = seen.get(word)
                    if place is None:
                        whole = ranks.get(word)
                        direct = whole is not None or len(word) > long
                        if direct:
                            known.append([whole] if whole is not None else heaped(word, ranks))
                        else:
                            new.append(word)
                        seen[word] = place = 2 * sizes[direct] + direct
                        sizes[direct] += 1
                    places.append(place)
                slices = [new[k : k + _SLICE] for k in range(0, len(new), _SLICE)]
                bytes_ = np.frombuffer(b"".join(new), np.uint8).astype(np.int16)
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, new)]), pa.int32()), pa.array(bytes_))
                outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, slices)]), pa.int32()), inner)
                n = len(slices)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int32()), outer, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_FOLDING)
                direct_ids = _pack(_planes(np.array([len(k) for k in known], np.int64)), _planes(np.array([i for k in known for i in k], np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int32()), pa.nulls(1, _FOLDING.field("words").type), pa.array([direct_ids]), pa.array([chunk], pa.int64()), pa.array([_pack(numbers, _planes(np.array(places)))])], schema=_FOLDING
                )

    return run


class _Grown:
    """Ids of words one after another, with room to grow."""

    def __init__(self):
        self.ids, self.bounds, self.n, self.size = np.empty(1024, "<u4"), np.zeros(256, np.int64), 0, 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(sizes) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.empty_like(self.bounds)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.bounds[self.n + 1 : self.n + 1 + len(sizes)] = self.size + np.cumsum(sizes)
        self.n, self.size = self.n + len(sizes), self.size + len(ids)


@frugal
def _returned(batches):
    """Of _met's rows with ids for words: for each list its numbers and their ids, packed."""
    bucket, kinds = None, (_Grown(), _Grown())
    for b in batches:
        rows: list[tuple[int, bytes]] = []
        ids = b.column("ids")
        for k, (key, known, chunk) in enumerate(zip(b.column("bucket").to_pylist(), b.column("known").to_pylist(), b.column("chunk").to_pylist())):
            if key != bucket:
                bucket, kinds = key, (_Grown(), _Grown())
            if known is None:
                each = ids[k].values
                kinds[0].add(each.value_lengths().to_numpy(zero_copy_only=False), each.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
                continue
            kinds[1].add(*map(_numbers, _unpack(known)))
            numbers, at = _unpack(b.column("places")[k].as_py())
            places = _numbers(at).astype(np.int64)
            direct, which = places & 1 > 0, places >> 1
            sizes = np.empty(len(places), np.int64)
            for kind, of in enumerate((~direct, direct)):
                sizes[of] = kinds[kind].bounds[which[of] + 1] - kinds[kind].bounds[which[of]]
            flat, ends = np.empty(int(sizes.sum()), "<u4"), np.cumsum(sizes)
            owner = np.repeat(direct, sizes)
            for kind, of in enumerate((~direct, direct)):
                flat[owner == bool(kind)] = _spread(kinds[kind].ids, kinds[kind].bounds, which[of])
            rows.append((chunk, _pack(numbers, _planes(sizes), _planes(flat))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "ids"])


def dictionaries(lists: DataFrame, ranks: dict[bytes, int], parts: int, long: int = LONG) -> str:
    """Folds the distinct words of all chunks; returns the folder with the numbers and ids of each chunk's words, in `parts` folders by chunk."""
    table = RankMap(ranks)
    met = lists.repartition(max(1, parts // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(_met(ranks, long), FOLDING)
    ids = met.select("bucket", "known", "chunk", "places", table.within(lambda: F.transform("words", lambda w: folded(w, table))).alias("ids"))
    path = f"{shared_dir(lists.sparkSession)}/dictionaries"
    back = ids.mapInArrow(_returned, "chunk long, ids binary").withColumn("part", F.pmod("chunk", F.lit(parts)).cast("int"))
    back.repartition("part").sortWithinPartitions("part", "chunk").write.option("compression", "uncompressed").option("parquet.block.size", 8 << 20).partitionBy("part").parquet(path)
    return path


def _loaded(path: str, parts: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's ids, word after word in order of number, and the bounds of its words."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(f"{path}/part={chunk % parts}")
    numbers, sizes, flat = [], [], []
    for packed in ds.dataset(at, filesystem=store, format="parquet").to_table(columns=["ids"], filter=ds.field("chunk") == chunk)["ids"].to_pylist():
        n, k, i = _unpack(packed)
        numbers.append(np.cumsum(_numbers(n).astype(np.int64)))
        sizes.append(_numbers(k).astype(np.int64))
        flat.append(_numbers(i))
    order = np.argsort(np.concatenate(numbers))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return _spread(np.concatenate(flat), bounds, order), np.concatenate([[0], np.cumsum(np.diff(bounds)[order])])


def _spread(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[bounds[w]:bounds[w + 1]] for each w of which, one after another."""
    starts, sizes = bounds[which], bounds[which + 1] - bounds[which]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _pieces(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in order of id, and their bounds."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def _concatenated(ids: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> bytes:
    """The pieces of all ids, one after another; many ids in parts."""
    return b"".join(_spread(flat, bounds, ids[s : s + _SOME].astype(np.int64)).tobytes() for s in range(0, len(ids), _SOME))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, decode: bool = False) -> DataFrame:
    """doc_id, ids for every row of docs (doc_id, text): ids as little-endian unsigned 32-bit integers in one binary.

    With decode also `decoded`: the bytes that these ids decode to, by the same task, so no ids travel for it.  A null or
    empty text has empty ids; repeated rows are encoded each; other columns are ignored; an empty table gives an empty
    result.  Texts of any length are encoded whole.
    """
    small_batches(docs.sparkSession)
    # a bucket holds its distinct words in a task's memory, so there are as many as the text asks for
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    with _short_plans(docs.sparkSession):
        table = stored(coded(docs, pattern, parts), "coded")
        path = dictionaries(table.where("bucket IS NOT NULL").select("chunk", "bucket", "words"), ranks, parts)
    give_back()
    pieces = _pieces(ranks) if decode else None
    names = ["doc_id", "ids", "decoded"] if decode else ["doc_id", "ids"]

    @frugal
    def run(batches):
        last: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None
        for b in batches:
            ids: list[bytes] = []
            texts: list[bytes] = []
            done, held = 0, 0

            def out():
                columns = [b.column("doc_id").slice(done, len(ids)), pa.array(ids, pa.binary())]
                return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())] if decode else columns, names)

            for chunk, codes in zip(b.column("chunk").to_pylist(), b.column("codes")):
                codes = codes.as_py()
                found = np.zeros(0, "<u4")
                if codes:
                    if last is None or last[0] != chunk:
                        last = None
                        last = chunk, _loaded(path, parts, chunk)
                    codes = _numbers(codes)
                    found = np.concatenate([_spread(*last[1], codes[s : s + _SOME].astype(np.int64)) for s in range(0, len(codes), _SOME)])
                ids.append(found.tobytes())
                held += len(ids[-1])
                if decode:
                    texts.append(_concatenated(found, *pieces))
                    held += len(texts[-1])
                if held > 1 << 21:
                    yield out()
                    done, ids, texts, held = done + len(ids), [], [], 0
            yield out()

    return table.where("bucket IS NULL").select("chunk", "doc_id", "codes").mapInArrow(run, "doc_id long, ids binary" + (", decoded binary" if decode else ""))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of packed ids: the pieces of all ids concatenated; null for null."""
    pieces = _pieces(ranks)

    @F.arrow_udf("binary")
    def decode(packed: pa.Array) -> pa.Array:
        return pa.array([None if p is None else _concatenated(np.frombuffer(p, "<u4"), *pieces) for p in packed.to_pylist()], pa.binary())

    return decode(ids)
