"""Vectorised text kernels over Arrow buffers.

Every function takes a string or binary Arrow array and works on its value buffer directly, in blocks of
about `BLOCK` bytes, so memory does not follow the size of a batch.  A null text counts as empty.

A word's hash is the sum of a mixed number for each of its bytes and that byte's place in the word, mixed again with the
length: no polynomial, as over Z/2^64 two words of a few thousand letters can agree under every base.  Short byte
sequences of a fixed length are hashed with such a polynomial: with prefix sums H, that of bytes s..e is
(H[e] - H[s]) * P^-s, which gives all of a block in a few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []

#: The white space of the word contract: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 white space or control, 1 letter, digit or any byte of a non-ASCII character, 2 punctuation.
KIND = np.full(256, 2, np.uint8)
KIND[:33] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, BLOCK + 1024)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high bits depend on all bits of its input."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H and the inverse powers, for grams()."""
    power, inverse = _powers(len(buf))
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return total, inverse


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from start to end, which don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sizes = end - start
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    each = buf[np.repeat(start, sizes) + place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)
    return mix(np.add.reduceat(mix(each), firsts) + sizes.astype(np.uint64))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their bounds, without a copy where Arrow allows it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def groups(bounds: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes; a longer text is alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def tokens(buf: np.ndarray, bounds: np.ndarray, kinds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a block; kinds: tokens are runs of one kind instead of runs without white space."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = (~SPACE[buf]).view(np.uint8) if kinds is None else kinds[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[bounds[(bounds >= 0) & (bounds <= len(buf))]] = True
    at = np.flatnonzero(edge)
    inside = kind[at[:-1]] > 0
    return at[:-1][inside], at[1:][inside]


def _pieces(buf: np.ndarray, kinds: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Cuts a long text where a token ends."""
    s, n = 0, len(buf)
    while s < n:
        e, width = min(n, s + BLOCK), BLOCK
        while e < n:
            kind = (~SPACE[buf[s:e]]).view(np.uint8) if kinds is None else kinds[buf[s:e]]
            cut = np.flatnonzero(kind[1:] != kind[:-1])
            if len(cut):
                e = s + int(cut[-1]) + 1
                break
            width *= 2
            e = min(n, s + width)
        yield s, e
        s = e


def words(texts: pa.Array, lower: bool = False, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens, text by text, and the number of tokens of each text."""
    data, bounds = raw(texts)
    found, counts = [], np.zeros(len(bounds) - 1, np.int64)
    for i, j in groups(bounds):
        part = data[bounds[i] : bounds[j]]
        part = LOWER[part] if lower else part
        rel = bounds[i : j + 1] - bounds[i]
        for s, e in [(0, len(part))] if len(part) <= 2 * BLOCK else _pieces(part, kinds):
            block = part[s:e]
            at, to = tokens(block, rel - s, kinds)
            found.append(word_hashes(block, at, to))
            if j - i == 1:
                counts[i] += len(at)
            else:
                counts[i:j] += np.diff(np.searchsorted(at, rel))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-token sequences of each text, and their number per text."""
    total = len(hashes)
    sizes = np.maximum(counts - (n - 1), 0)
    if total < n or not sizes.any():
        return np.zeros(0, np.uint64), sizes
    out = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xF1357AEA2E62A9C5) + hashes[k : total - n + 1 + k]
    ends = np.repeat(np.cumsum(counts), counts)[: len(out)]
    keep = np.arange(n, n + len(out)) <= ends  # a sequence that reaches into the next text goes
    return mix(out[keep] + np.uint64(n)), sizes


def grams(block: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-byte sequences within each text of a block, and the positions where they start."""
    m = len(block) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, inverse = prefix(block)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:m]
    keep = np.arange(n, n + m) <= ends
    at = np.flatnonzero(keep)
    return mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n)), at
